"""Redaction, sensitive spans and release against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import release
from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Highway|Hwy"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])")
ADDRESS = re.compile(rf"\b\d{{1,6}}\s+[A-Za-z0-9.' -]{{2,80}}\s+(?:{STREETS})\b\.?", re.I)
IP = re.compile(rf"\b(?:{OCTET}\.){{3}}{OCTET}\b")
CARD = re.compile(r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)")
PHONE = re.compile(r"(?<!\w)(?:\+?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,14}\d(?!\w)")


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def redact(text):
    for pattern, name in ((EMAIL, "EMAIL"), (ADDRESS, "ADDRESS"), (IP, "IP")):
        text = pattern.sub(f"[REDACTED_{name}]", text)
    text = CARD.sub(lambda m: "[REDACTED_PAYMENT_CARD]" if luhn(m[0]) else m[0], text)
    return PHONE.sub("[REDACTED_PHONE]", text)


def test_redacted_documents_match_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.text_md5, r.changed) for r in catalog.queries()["b7_redact_text"](spark, SF).collect()}
    assert got == {k: (hashlib.md5(redact(t).encode()).hexdigest(), redact(t) != t) for k, t in texts.items()}
    assert sum(changed for _, changed in got.values()) > 3


def mask(text):
    text = re.sub(r"(?i)([a-z][a-z0-9+.-]*://)[^/@\s:]+(?::[^/@\s]*)?@", r"\1[REDACTED_CREDENTIALS]@", text)
    text = re.sub(r"(?i)([?&](?:api[_-]?key|access[_-]?token|token|password|passwd|secret)=)[^&#\s]+", r"\1[REDACTED_SECRET]", text)
    names = "api[_-]?key|access[_-]?token|auth[_-]?token|token|password|passwd|secret"
    text = re.sub(rf"(?i)((?<![a-z0-9_-])(?:{names})\s*[:=]\s*)(?:['\"][^'\"\r\n]{{1,4096}}['\"]|[^\s,;)}}\]>]{{1,4096}})", r"\1[REDACTED_SECRET]", text)
    part, last = r"[^/\s'\"<>]", r"[^/\s'\"<>,;:)}\]]"
    for path in (r"(?i)\bfile://(?:localhost)?/[^\s'\"<>]+", r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[^\\\s:*?\"<>|]+\\)*[^\\\s:*?\"<>|]*", rf"(?<!\w)~/(?:{part}+/)*{part}*", rf"(?<![:/A-Za-z0-9_])/(?:{part}+/)+{last}*"):
        text = re.sub(path, "[REDACTED_PATH]", text)
    for pattern, name in ((EMAIL, "EMAIL"), (ADDRESS, "ADDRESS"), (IP, "IP")):
        text = pattern.sub(f"[REDACTED_{name}]", text)
    return PHONE.sub(lambda m: m[0] if re.fullmatch(r"(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", m[0]) else "[REDACTED_PHONE]", text)


def test_masked_pages_match_python(spark):
    expected = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        for field, value in (("url", r.url), ("html", r.html)):
            expected[r.page_id, field] = hashlib.md5(mask(value or "").encode()).hexdigest()
    assert {(r.page_id, r.field): r.masked_md5 for r in catalog.queries()["b8_masked_metadata"](spark, SF).collect()} == expected


TEXTS = [
    (1, "mail a.b@c.org. ip 10.0.0.1, 300.1.1.1, 01.2.3.4 token: 'abcdefgh12' card 4539 1488 0343 6467"), (2, "nothing here"), (3, None), (4, "password=hunter2hunter x"),
    (5, "token=me@host.org12345 and more"), (6, "öäü 🙂 x@y.de"), (7, ""), (8, "card 4111-1111-1111-1112"),
]
POLICIES = [("model_input", "allow", None), ("audit_export", "redact", ["native"]), ("external_provider", "block", ["phones"])]
RULES = [("model_input", "secret", "block", 0.9), ("model_input", "email", "redact", 0.0), ("audit_export", "secret", "redact", 0.0), ("audit_export", "ip_address", "redact", 0.96), ("external_provider", "email", "allow", 0.0)]


def test_release(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("action", F.lit("clash"))
    spans = release.sensitive_spans(docs)
    found = {(r.doc_id, r.start, r.end, r.category) for r in spans.collect()}
    t1 = TEXTS[0][1]
    at = lambda part: (t1.index(part), t1.index(part) + len(part))
    assert {f[1:] for f in found if f[0] == 1} == {(*at("10.0.0.1"), "ip_address"), (*at("abcdefgh12"), "secret"), (*at("4539 1488 0343 6467"), "payment_card")}
    assert (6, 6, 12, "email") in found and not [f for f in found if f[0] in (2, 3, 7, 8)]
    scans = spark.createDataFrame([(1, "phones"), (2, "phones"), (6, "phones"), (6, "phones")], "doc_id long, detector string")
    policies = spark.createDataFrame(POLICIES, "destination string, default_action string, required array<string>")
    rules = spark.createDataFrame(RULES, "destination string, category string, action string, minimum double")
    rows = {(r.doc_id, r.destination): r for r in release.release_texts(docs, spans, scans, policies, rules).collect()}
    assert len(rows) == len(TEXTS) * 3
    assert rows[1, "model_input"].action == "block" and rows[1, "model_input"].released is None
    audit = rows[1, "audit_export"]
    assert audit.released == t1.replace("abcdefgh12", "[REDACTED:secret]").replace("4539 1488 0343 6467", "[REDACTED:payment_card]") and audit.reasons == ["sensitive_spans_redacted"]
    assert rows[1, "external_provider"].reasons == ["blocking_sensitive_category_detected"]
    assert rows[4, "external_provider"].reasons == ["blocking_sensitive_category_detected", "required_detector_attestation_missing"]
    assert rows[2, "external_provider"].action == "allow" and rows[3, "external_provider"].action == "block" and rows[3, "model_input"].released == ""
    assert rows[6, "external_provider"].released == TEXTS[5][1] and rows[6, "audit_export"].released == "öäü 🙂 [REDACTED:email]"
    assert rows[5, "audit_export"].action == "allow" and rows[5, "audit_export"].released == TEXTS[4][1]
    two = rules.unionByName(spark.createDataFrame([("model_input", "email", "block", 0.0)], rules.schema))
    with pytest.raises(Exception, match="two rules"):
        release.release_texts(docs, spans, scans, policies, two).collect()


def test_overlapping_spans_merge(spark):
    spans = [(1, 0, 4, "email"), (1, 2, 6, "secret"), (1, 6, 8, "phone"), (1, 3, 5, "email"), (1, 20, 30, "email"), (1, 21, 22, "phone"), (2, 0, 1, "phone")]
    got = release.redaction_segments(spark.createDataFrame(spans, "doc_id long, start long, end long, category string"), ["doc_id"])
    assert {tuple(r) for r in got.select("doc_id", "start", "end", "label").collect()} == {
        (1, 0, 6, "[REDACTED:email+secret]"), (1, 6, 8, "[REDACTED:phone]"), (1, 20, 30, "[REDACTED:email+phone]"), (2, 0, 1, "[REDACTED:phone]")
    }


def test_released_documents_match_python(spark):
    """The registered query: merged and replaced spans of every document, by brute force."""
    rows = {(r.doc_id, r.destination): (r.action, r.released_sha256) for r in catalog.queries()["b10_release"](spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, spans = doc.text, list(release.text_spans(doc.text))
        for destination, rule in (("model_input", {"secret": "block"}), ("audit_export", {"ip_address": "allow"}), ("external_provider", {"email": "block"})):
            acts = [(s, rule.get(s[2], "redact")) for s in spans]
            if any(a == "block" for _, a in acts) or (destination == "external_provider" and doc.lang != "en"):
                assert rows[doc.doc_id, destination] == ("block", None)
                continue
            marks = sorted((s[:3]) for s, a in acts if a == "redact")
            covered, out, i = {}, [], 0
            for s, e, c in marks:
                for at in range(s, e):
                    covered.setdefault(at, set()).add(c)
            merged = []
            for s, e, c in marks:
                if merged and s < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2] | {c})
                else:
                    merged.append((s, e, {c}))
            for s, e, cs in merged:
                out += [text[i:s], f"[REDACTED:{'+'.join(sorted(cs))}]"]
                i = e
            done = "".join([*out, text[i:]])
            assert rows[doc.doc_id, destination] == ("redact" if merged else "allow", hashlib.sha256(done.encode()).hexdigest())
