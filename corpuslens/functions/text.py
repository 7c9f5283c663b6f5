"""Column functions over text, urls and dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "during", "each", "for", "from", "further",
    "had", "has", "have", "having", "how", "if", "in", "into", "is", "it", "its", "may", "more", "most", "no", "not",
    "of", "on", "only", "or", "other", "our", "out", "over", "same", "should", "so", "some", "such", "than", "that",
    "the", "their", "then", "there", "these", "they", "this", "those", "through", "to", "under", "up", "very", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "would", "you", "your",
)
SINGLE = ("x", "y", "z", "r", "p", "q")
TRACKING = (
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source",
    "utm_term",
)
INDEX_TOKEN = r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*"
FIELD_TOKEN = r"[A-Za-z0-9]+(?:[._:/+-][A-Za-z0-9]+)*"
#: (kind, pattern) of instruction-like text in retrieved content; fixed values.
INJECTION = (
    ("instruction_override", r"(?is)\b(ignore|disregard|override)\b.{0,80}\b(previous|prior|system|developer|instructions?)\b"),
    ("authority_impersonation", r"(?i)\b(system|developer|assistant)\s*(message|prompt|instruction|role)\b"),
    ("tool_execution_request", r"(?is)\b(call|invoke|execute|run|use)\b.{0,60}\b(tool|function|command|shell|terminal)\b"),
    ("secret_exfiltration_request", r"(?is)\b(reveal|print|dump|send|exfiltrate)\b.{0,80}\b(secret|token|credential|api[- ]?key|system prompt)\b"),
    ("role_delimiter_like", r"(?i)(^|\n)\s*(system|developer|assistant|tool)\s*[:>]"),
)


def index_tokens(text: Column) -> Column:
    """Search tokens in order: words with inner ``-./``, lower case, without stop words and most single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({INDEX_TOKEN})"), 1)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) > 1) | t.rlike("^[0-9]$") | t.isin(*SINGLE)))


def field_tokens(text: Column) -> Column:
    """Tokens of the fielded index: ASCII words, lower case, stop words kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({FIELD_TOKEN})"), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def snippet(text: Column, max_words: int = 40) -> Column:
    """The first words joined by single spaces, with an ellipsis when cut."""
    w = words(text)
    head = F.array_join(F.slice(w, 1, max_words), " ")
    return F.when(F.size(w) > max_words, F.concat(head, F.lit("…"))).otherwise(head)


def url_parts(url: Column) -> dict[str, Column]:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "authority": F.regexp_extract(rest, r"^([^/?]*)", 1),
        "path": F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1),
        "query": F.regexp_extract(rest, r"\?(.*)$", 1),
    }


def normalized_url(url: Column) -> Column:
    """Canonical http(s) url, or null: lower scheme and host, no default port, fragment, tracking or trailing slash."""
    p = url_parts(url)
    host = F.lower(F.regexp_extract(p["authority"], r"^([^:]*)", 1))
    port = F.regexp_extract(p["authority"], r":([0-9]+)$", 1)
    default = ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443"))
    netloc = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "/+", "/")
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    kept = F.array_sort(F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    good = p["scheme"].isin("http", "https") & (host != "") & ~p["authority"].contains("@")
    return F.when(good, F.concat(p["scheme"], F.lit("://"), netloc, path, query))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url_parts(url)["authority"], r"^([^:]*)", 1))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, white space single."""
    body = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]*)"'), 1)


def normalized_answer(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")


def freshness(age_seconds: Column, half_life: float, floor: float = 0.0) -> Column:
    return floor + (1 - floor) * F.pow(F.lit(0.5), age_seconds / half_life)


def calibrated(score: Column, temperature: float = 1.0, bias: float = 0.0, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(score, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-(F.log(p / (1 - p)) / temperature + bias)))


def content_id(*parts: Column) -> Column:
    """Identity derived from content: SHA-256 of the parts joined by a unit separator."""
    return F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)


#: What ``redacted`` masks, in this order; cards are checked besides.  Fixed values; ``(?U)`` gives words and digits of all scripts.
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Highway|Hwy"
_EMAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
_ADDRESS = rf"(?iU)\b\d{{1,6}}\s+[A-Za-z0-9.' -]{{2,80}}\s+(?:{_STREETS})\b\.?"
_IP = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
_CARD = r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"
_PHONE = r"(?U)(?<!\w)(?:\+?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,14}\d(?!\w)"
_ISO_DATE = r"(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"


def luhn_valid(number: Column) -> Column:
    """13 to 19 digits, not all the same, that pass Luhn's check; other characters are ignored."""
    digits = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("([0-9])"), 1), lambda c: c.cast("int"))
    parts = F.transform(digits, lambda v, i: F.when(i % 2 == 0, v).otherwise((v * 2) % 10 + F.floor(v / 5).cast("int")))
    total = F.aggregate(parts, F.lit(0), lambda a, v: a + v)
    return F.size(digits).between(13, 19) & (F.size(F.array_distinct(digits)) > 1) & (total % 10 == 0)


def replaced(text: Column, pattern: str, shown: str, holds: Callable[[Column], Column]) -> Column:
    """``text`` with those matches of ``pattern`` replaced for which ``holds``."""
    found = F.concat(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.array(F.lit("")))
    kept = F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: F.concat(gap, F.when((x != "") & holds(x), shown).otherwise(x)))
    return F.array_join(kept, "")


def redacted(text: Column) -> Column:
    """``text`` with e-mail addresses, street addresses, IPv4 addresses, payment cards and phone numbers masked."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _EMAIL, "[REDACTED_EMAIL]")
    t = F.regexp_replace(t, _ADDRESS, "[REDACTED_ADDRESS]")
    t = F.regexp_replace(t, _IP, "[REDACTED_IP]")
    t = replaced(t, _CARD, "[REDACTED_PAYMENT_CARD]", luhn_valid)
    return F.regexp_replace(t, _PHONE, "[REDACTED_PHONE]")


def pseudonym(identity: Column, secret: str) -> Column:
    """Keyed pseudonym: the secret goes into an inner and an outer SHA-256, so an identity can't be tried without it."""
    inner = F.sha2(F.concat(F.lit(secret), identity.cast("string")), 256)
    return F.sha2(F.concat(F.lit(secret), inner), 256)


def bibtex(kind: str, key: Column, fields: dict[str, Column]) -> Column:
    """One BibTeX entry; special characters of the values are escaped and line breaks become spaces."""
    escape = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\r\n\t ]+", " "), r"([&%$#_{}])", r"\\$1")
    lines = [F.concat(F.lit(f"  {name} = {{"), escape(value), F.lit("}")) for name, value in fields.items()]
    return F.concat(F.lit(f"@{kind}{{"), key.cast("string"), F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


#: What metadata must not show, with its replacement, in the order of replacing; fixed values.  Loops over parts of a path
#: are possessive: they match the same, without a stack that grows with the path.
MASKS = (
    (r"(?iU)([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s:]+(?::[^/@\s]*)?@", "$1[REDACTED_CREDENTIALS]@"),
    (r"(?iU)([?&](?:api[_-]?key|access[_-]?token|token|password|passwd|secret)=)[^&#\s]+", "$1[REDACTED_SECRET]"),
    (
        r"(?iU)((?<![A-Za-z0-9_-])(?:api[_-]?key|access[_-]?token|auth[_-]?token|token|password|passwd|secret)\s*[:=]\s*)"
        r"(?:['\"][^'\"\r\n]{1,4096}['\"]|[^\s,;)}\]>]{1,4096})",
        "$1[REDACTED_SECRET]",
    ),
    (r"(?iU)\bfile://(?:localhost)?/[^\s'\"<>]+", "[REDACTED_PATH]"),
    (r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[^\\\s:*?\"<>|]++\\)*+[^\\\s:*?\"<>|]*", "[REDACTED_PATH]"),
    (r"(?U)(?<!\w)~/(?:[^/\s'\"<>]++/)*+[^/\s'\"<>]*", "[REDACTED_PATH]"),
    (r"(?<![:/A-Za-z0-9_])/(?:[^/\s'\"<>]++/)++[^/\s'\"<>,;:)}\]]*", "[REDACTED_PATH]"),
    (_EMAIL, "[REDACTED_EMAIL]"),
    (_ADDRESS, "[REDACTED_ADDRESS]"),
    (_IP, "[REDACTED_IP]"),
)


def masked_metadata(value: Column) -> Column:
    """Metadata without credentials in addresses, secret parameters and assignments, paths, e-mail, street and IP addresses and phones.

    Dates in ISO form are no phones, and payment cards are masked as phones are.
    """
    text = F.coalesce(value, F.lit(""))
    for pattern, shown in MASKS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(shown))
    return replaced(text, _PHONE, "[REDACTED_PHONE]", lambda x: ~x.rlike(f"^{_ISO_DATE}$"))
