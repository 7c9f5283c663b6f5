"""Small cases and brute-force comparisons of the training-text operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm import bloom, decontam, langid, line_rules, linetree, mixing, pii, probminhash, quality_crf, sharding, urlgraph
from corpuslens.llm.common import Words, chunks, windows
from corpuslens.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, row string, part int"
W = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Documents with two columns that operators use as names of their own."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local(documents):
    return documents.toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 997} the and of {i}" for i in range(9000))
    return docs_of(
        spark,
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, " \t\n\r ", "en", None),
            (4, "one two three", "en", "a"),
            (5, "one  two\nthree", "en", "b"),
            (6, long, "en", "a"),
            (7, long + " tail", "fr", "a"),
            (7, long + " tail", "fr", "a"),
            (None, "mail me@example.org or 10.0.0.1", None, "b"),
            (9, "数字 données ñandú 12345", "fr", "b"),
        ],
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# shared helpers


def test_words_and_windows_match_plain_python():
    texts = ["a bb  ccc\nd", "", "\x0b x ", "é ñ é ñ é", "a bb ccc d"]
    for _, _, raw, off in chunks(pa.array(texts)):
        words = Words(raw, off)
        counts = np.diff(words.bounds).tolist()
        assert counts == [len(W.findall(t)) for t in texts]
        assert words.hash[:4].tolist() == words.hash[-4:].tolist()
        h, at = windows(words.hash, words.doc, 2)
        assert len(h) == sum(max(0, c - 1) for c in counts)
        assert h[-7] == h[-5]  # "é ñ" twice


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 201), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert got[102] == 100 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_never_loses_a_key(spark):
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(500)]
    words = bloom.build(spark.createDataFrame([(k,) for k in keys], "key binary"))
    assert all(bloom.holds(words, k) for k in keys)
    assert sum(bloom.holds(words, hashlib.md5(f"x{i}".encode()).digest()) for i in range(500)) < 3
    h = np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    filled = bloom.build_long(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "k long"), "k")
    assert bloom.holds_long(filled, h).all()


# 1 sharding


def test_shards_hold_every_row_in_gapless_places(spark, documents, local, odd):
    for docs, n in ((documents, len(local)), (odd, 10)):
        got = sharding.shard_records(docs, 8).toPandas()
        assert len(got) == n
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
    got = sharding.shard_records(documents, 8).toPandas().merge(local, on="doc_id")
    assert all(got["size"] == [len(t.encode()) + 1 for t in got.text])
    assert all(got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text])
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= max(0.02 * load.mean(), got["size"].max())


def test_one_hot_key_is_dealt_over_shards(spark):
    rows = [(5, "same text here", "en", "a")] * 600 + [(i, "other text", "en", "a") for i in range(300)]
    got = sharding.shard_records(docs_of(spark, rows).repartition(3), 4).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 4 and load.max() < 1.5 * load.mean()


def test_rebalancing_edits_few_slots(spark, empty):
    first = sharding.first_map([(s, -1, 100 + s) for s in range(256)], 4)
    grown = sharding.rebalanced(first, 5)
    assert {r[0] for r in grown} == {2}
    was, now = {r[1]: r[4] for r in first}, {r[1]: r[4] for r in grown}
    moved = [s for s in was if was[s] != now[s]]
    assert sum(now[s] != 4 for s in moved) <= 4 and 0.1 < len(moved) / 256 < 0.3
    back = sharding.rebalanced(grown, 4)
    assert {r[4] for r in back} == {0, 1, 2, 3} and sum(now[r[1]] != r[4] for r in back if now[r[1]] < 4) <= 4
    assert sharding.shard_records(empty, 8).count() == 0


def test_a_stored_map_is_edited(spark, documents, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.shard_records(documents, 4, map_path=path)
    slots = {(r.virtual_slot, r.shard) for r in first.collect()}
    assert {r[0] for r in sharding.load_map(spark, path)} == {2} and {r[0] for r in sharding.load_map(spark, path, 1)} == {1}
    again = sharding.shard_records(documents, 4, map_path=path)
    assert {(r.virtual_slot, r.shard) for r in again.collect()} == slots and sharding.load_map(spark, path)[0][0] == 2
    sizes = {r.virtual_slot: r.b for r in first.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}
    assert {r[1]: r[3] for r in sharding.load_map(spark, path) if r[2] == -1}.items() <= sizes.items()
    grown = sharding.shard_records(documents, 5, map_path=path)
    moved = {(r.virtual_slot, r.shard) for r in grown.collect()} - slots
    assert len(moved) < 60 and sum(s == 4 for _, s in moved) >= len(moved) - 3 and sharding.load_map(spark, path)[0][0] == 3


# 2 personal data

PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_of(text):
    out = []
    for kind, pattern in PII_PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.com_x@y.org then a@b.c@d.e and @no.where x@y",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4 1",
    "+1 (523) 555-1055 +12 +1.2.3.4.5.6.7.8.9 ++33 1 23 45 67 89 end",
    "é😀 ñ me@x.io 😀 8.8.8.8",
    "7" * 30000 + " " + "a" * 30000,
    "1 " * 3000,
]


def test_base_spans_match_plain_regexes(spark, documents, local, odd):
    hard = docs_of(spark, [(i, t, None, None) for i, t in enumerate(HARD)])
    for docs in (hard, documents, odd):
        text = {r.doc_id: r.text for r in docs.collect()}
        for r in pii.scan_documents(docs).collect():
            expected = base_of(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
            assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
            assert (r.n_email, r.n_ip) == (expected.count("email:"), expected.count("ip:"))


def test_contexts_of_seeds_find_identifiers_without_base_pattern(spark, empty):
    rows = [(i, f"please call my number +1 (523) 555-10{i:02d} before noon today", "en", "a") for i in range(12)]
    rows += [(100, "please call my number 555-0199 before noon today", "en", "a")]
    rows += [(200 + i, f"chapter {i} has words", "en", "a") for i in range(12)]
    got = {r.doc_id: r for r in pii.scan_documents(docs_of(spark, rows)).collect()}
    assert got[100].spans == "ctx_phone:22:30"
    assert all(got[200 + i].spans == "" for i in range(12))
    masked = {r.doc_id: r.text for r in pii.masked_documents(docs_of(spark, rows)).collect()}
    assert masked[100] == "please call my number <ctx_phone> before noon today"
    assert masked[0] == "please call my number <phone> before noon today"
    assert pii.scan_documents(empty).count() == 0


def test_secrets_are_found_by_context(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'some words then token = "{key(i)}" and more', "en", "a") for i in range(20)]
    rows += [(50, 'more words then token="Zx81-unseen-form-77", too', "en", "a"), (51, f"a commit {key(99)} alone", "en", "a")]
    rows += [(60 + i, f"dial my number +1 (523) 555-10{i:02d} today", "en", "a") for i in range(12)] + [(90, "dial my number 020 7946 0958 today", "en", "a")]
    got = {r.doc_id: r for r in pii.scan_documents(docs_of(spark, rows)).collect()}
    assert got[3].spans == "ctx_secret:25:65" and got[51].spans == "" and got[50].spans == "ctx_secret:23:42"
    assert got[90].spans == "ctx_phone:15:28"  # a run of numbers is one identifier


# 3 quality rules


def base_counts(text):
    words = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {p + q for x in at.values() if len(x) > 1 for p in x for q in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark, documents, odd, empty):
    more = docs_of(spark, [(20, "a b c a b c a b c", "en", "a"), (21, "x y\n\nx y\n \nx y", "en", "a"), (22, "a a a a", None, None)])
    for docs in (documents, odd, more):
        text = {r.doc_id: r.text for r in docs.collect()}
        for r in line_rules.line_verdicts(docs).collect():
            expected = base_counts(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
            assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    assert line_rules.line_verdicts(empty).count() == 0


def test_lines_above_a_hosts_limit_deplete(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    shared = " ".join(f"common{j}" for j in range(60))
    rows = [(i, f"{shared} {2000 + i}", "en", "a") for i in range(40)]
    rows += [(100 + i, f"{shared} {i}\n{body(i)}", "en", "a") for i in range(10)]
    rows += [(200 + i, f"{shared} {i}", "en", "b") for i in range(10)]
    got = {r.doc_id: r for r in line_rules.line_verdicts(docs_of(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(40))
    assert all(got[100 + i].kept and got[100 + i].removed_lines == 1 for i in range(10))
    assert all(got[200 + i].kept for i in range(10))  # below the limit of its host


def test_a_hosts_limit_has_a_ceiling(spark):
    shared = " ".join(f"common{j}" for j in range(60))
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    rows = [(i, f"{shared}\n{own(i % 26)}{i // 26 * 'z'}", "en", "a") for i in range(30)]
    rows += [(100 + i, own(i % 26)[::-1] + i // 26 * "z", "en", "a") for i in range(30)]
    got = {r.doc_id: r for r in line_rules.line_verdicts(docs_of(spark, rows), host_share=0.9, most_docs=25).collect()}
    assert all(got[i].removed_lines == 1 for i in range(30)) and all(got[100 + i].removed_lines == 0 for i in range(30))


def test_line_frequency_matches_brute_force(spark, documents, local):
    limits = {"min_docs": 1, "host_share": 0.02, "most_docs": 5, "keep_words": 50}
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" "))
    seen, hosts = defaultdict(set), Counter(local.source)
    lines = {i: [x for x in t.split("\n") if W.search(x)] for i, t in zip(local.doc_id, local.text, strict=True)}
    for i, s in zip(local.doc_id, local.source, strict=True):
        for x in lines[i]:
            seen[s, norm(x)].add(i)
    got = {r.doc_id: r for r in line_rules.line_verdicts(documents, **limits).collect()}
    rejected = 0
    for i, s, t in zip(local.doc_id, local.source, local.text, strict=True):
        most = max(1, min(0.02 * hosts[s], 5))
        gone = [x for x in lines[i] if len(seen[s, norm(x)]) > most]
        n, left = base_counts(t)[0], base_counts(t)[0] - sum(len(W.findall(x)) for x in gone)
        r = got[i]
        assert (r.removed_lines, r.removed_words) == (len(gone), n - left)
        assert r.kept == (not r.base_failed and left >= 0.3 * n and left >= 50)
        rejected += not r.base_failed and not r.kept
    assert sum(r.removed_lines for r in got.values()) > 0


# 4 decontamination


def test_passages_and_reparameterised_questions_are_caught(spark, empty):
    bench = spark.createDataFrame(
        [
            (1, "A train leaves Boston with 12 cars and returns with 7 cars after 12 hours of travel"),
            (2, "Short item here now"),
            (3, None),
            (4, ""),
        ],
        "item_id long, text string",
    )
    rows = [
        (1, "Noise before. A train leaves Boston with 12 cars and returns with 7 cars after 12 hours of travel. Noise.", "en", "a"),
        (2, "Some text. A train leaves Chicago with 31 cars and returns with 9 cars after 31 hours of travel, they say", "en", "a"),
        (3, "Some text. A train leaves Chicago with 31 cars and returns with 9 cars after 44 hours of travel, they say", "en", "a"),
        (4, "Nothing like it at all, with 12 cars and other things", "en", "a"),
        (5, "x short item here now y", "en", "a"),
        (6, None, None, None),
    ]
    got = decontam.contaminated(docs_of(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in got) == [(1, 1, True), (2, 1, False), (5, 2, True)]
    left = {r.doc_id for r in decontam.decontaminated(docs_of(spark, rows), bench).collect()}
    assert left == {3, 4, 6}
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_copies_of_items_dense_with_placeholders_are_caught(spark):
    texts = ["convert 5 km and 7 miles in 3 hours", "from Paris 12 May 1999 to Rome 3 June 2001"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, f"some words before {t}", "en", "a") for i, t in enumerate(texts)] + [(9, "we convert 8 km and 9 metres in 4 days", "en", "a")]
    got = decontam.contaminated(docs_of(spark, rows), bench).collect()
    # "convert", "and" and "in" are three plain words: with other amounts and units the item is still the same question
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in got) == [(0, 0, True), (1, 1, True), (9, 0, False)]


def planted_questions():
    """(items, copies with other values, near misses): word problems, sparse and dense in numbers, names and units."""
    draw = np.random.default_rng(3)
    words = ["carries", "takes", "walks", "lends", "sells", "bakes", "counts", "after", "before", "toward", "during", "beside", "apples", "crates", "tickets", "ribbons"]
    names, units = ["Anna", "Boris", "Clara", "David", "Elena", "Felix", "Greta", "Hugo"], ["km", "miles", "kg", "litres", "hours", "days"]
    items, copies, misses = [], [], []
    for i in range(120):
        dense = i % 2
        shape = ["w"]
        for _ in range(6):
            shape += ["w"] * int(draw.integers(1, 2 if dense else 5)) + [["#", "#u", "N"][int(draw.integers(3))]]
        text, spare = [], list(draw.permutation(np.arange(2, 99)))
        plain = [words[int(draw.integers(len(words)))] if s == "w" else None for s in shape]
        # one name and one number stand twice: a copy must change both alike
        slots = [(int(draw.integers(3)), int(draw.integers(3)), int(draw.integers(3))) for _ in shape]

        def text_of(number, name, unit, slots=slots, shape=shape, plain=plain):
            out = []
            for s, w, (a, b, c) in zip(shape, plain, slots, strict=True):
                out += [w] if s == "w" else [names[name[b]]] if s == "N" else [str(number[a])] + ([units[unit[c]]] if s == "#u" else [])
            return f"the {' '.join(out)} in all"

        one = text_of(spare[:3], draw.permutation(8), draw.permutation(6))
        other = text_of(spare[3:6], draw.permutation(8), draw.permutation(6))
        items.append(one)
        copies.append(other)
        # a near miss has the values of a copy and other words at three places out of four
        misses.append(" ".join(f"x{t}" if t.islower() and t.isalpha() and t not in units and k % 4 else t for k, t in enumerate(other.split())))
    return items, copies, misses


def test_reparameterised_questions_are_recalled(spark):
    items, copies, misses = planted_questions()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"They said that {t}, and so on", "en", "a") for i, t in enumerate(copies)] + [(1000 + i, f"They said that {t}, and so on", "en", "a") for i, t in enumerate(misses)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    found = sum((i, i) in got for i in range(len(items)))
    wrong = len({i for i, _ in got if i >= 1000})
    print("re-parameterised copies found", found, "of", len(items), "near misses taken", wrong, "other items", sum(i < 1000 and i != j for i, j in got))
    assert found >= 0.9 * len(items) and wrong <= 0.02 * len(items)


def test_verbatim_passages_match_substring_search(spark, documents, local):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    expected = {(i, b.item_id) for i, t in zip(local.doc_id, local.text, strict=True) for b in items if b.text in t}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents, bench).collect()}
    assert expected <= got and len(got) <= len(expected) + 1


# 5 language


def test_held_out_languages(documents, local, odd, empty):
    got = langid.identify(documents).toPandas().merge(local, on="doc_id")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    held = got[got.held_out & got.lang.notna() & (got.n_chars >= 20)]
    assert (held.lang_pred == held.lang).mean() >= 0.97
    few = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [few[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and few[1].score == 0
    assert len(langid.identify(odd).collect()) == 10
    assert langid.identify(empty).count() == 0
    kept = {r.doc_id for r in langid.accepted(documents).collect()}
    assert len(kept) >= 0.97 * len(local)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(2)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(20)] for _ in range(70)]
    rows = [(100 * i + j, " ".join(rng.choice(w, 15)), f"l{i:02d}", "a") for i, w in enumerate(words) for j in range(12)]
    got = langid.identify(docs_of(spark, rows)).collect()
    assert all(r.lang_pred == f"l{r.doc_id // 100:02d}" for r in got) and len(got) == 840
    few = langid.train(docs_of(spark, [(i, w[0] + w[1], "en", "a") for i, w in enumerate(words[:20])]))
    assert few.false_rate.max() < 1e-9  # n-grams of one row each, however few the rows


def test_grams_stay_inside_texts():
    for _, _, raw, off in chunks(pa.array(["ab", "", "c d", "1 2"])):
        g, doc = langid.grams(raw, off)
        found = [bytes(int(x).to_bytes(4, "big")) for x in g]
        assert found == [b" ab ", b" c d", b"c d "]
        assert doc.tolist() == [0, 2, 2]


def test_filters_agree_with_plain_sets(documents, local):
    """Masks hold every n-gram of each language; corrected counts are near those of plain sets, which decide alike."""
    model = langid.train(documents)
    rows = local[local.lang.notna() & np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in local.doc_id])]
    of = lambda t: [bytes(g[i : i + 4]) for g in [b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in t.lower().encode()) + b" "] for i in range(len(g) - 3) if g[i : i + 4].strip()]
    sets = {}
    for lang, part in rows.groupby("lang"):
        counts = Counter(g for t in part.text for g in set(of(t)))
        sets[lang] = {g for g, c in counts.items() if c >= max(2, int(np.ceil(len(part) * 0.01)))}
    assert sorted(sets) == model.languages and (rows.groupby("lang").size() <= langid.SAMPLE).all()
    expected = {}
    for i, t in zip(local.doc_id, local.text, strict=True):
        g = of(t)
        count = [sum(x in sets[lang] for x in g) for lang in model.languages]
        expected[i] = (model.languages[int(np.argmax(count))], max(count) / max(1, len(g)))
    for r in langid.identify(documents, model).collect():
        if r.lang_pred != "und":
            assert r.lang_pred == expected[r.doc_id][0] or expected[r.doc_id][1] < 0.2
            assert abs(r.score - expected[r.doc_id][1]) < 0.05


# 6 urls


def test_rules_and_hosts(spark):
    urls = [
        ("http://A.Example.com/en/7x", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://x.com/en/8?q=://z/", "x.com", "/en/8", "com/en/", "block"),
        ("https://example.net/de/81#f", "example.net", "/de/81", "example.net/de/8", "block"),
        ("https://notexample.net/de/81", "notexample.net", "/de/81", "net/de/", "allow"),
        ("ftp://a.org?x=/es/", "a.org", "", None, None),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h/es/", "h", "/es/", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in urlgraph.judge_urls(pages).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urlgraph.judge_urls(pages.limit(0)).count() == 0


def test_rank_matches_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("c", "e", 1.0)]
    seeds = {"a": 0.5, "d": 0.5}
    got = urlgraph.personalised_rank(
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame(list(seeds.items()), "host string, seed double"),
    )
    got = {r.host: r.rank for r in got.collect()}
    out = Counter()
    for s, _, w in edges:
        out[s] += w
    rank = dict(seeds)
    for _ in range(urlgraph.ROUNDS):
        lost = 0.85 * sum(v for k, v in rank.items() if k not in out)
        new = {k: v * (0.15 + lost) for k, v in seeds.items()}
        for s, d, w in edges:
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * w / out[s]
        rank = new
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-9 for k in rank)


def test_distrust_runs_against_links(spark):
    link = lambda h: f'<a href="http://{h}/x">y</a>'
    rows = [(1, "http://spam.com/en/1", ""), (2, "http://farm.info/a", link("spam.com")), (3, "http://good.example.com/en/7", link("fine.info")), (4, "http://fine.info/a", "")]
    got = {r.host: r for r in urlgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["farm.info"].verdict == "block" and got["fine.info"].verdict == "allow"


def test_hosts_without_rules_get_verdicts_from_their_domain(spark):
    rows = [(i, f"http://w{i % 3}.bad.org/es/{i}", '<a href="/x">y</a>') for i in range(30)] + [(100, "http://quiet.bad.org/en/1", None), (101, "http://fine.good.net/en/1", None)]
    rows += [(200 + i, f"http://w{i}.good.net/de/1", '<a href="y.html">y</a>') for i in range(5)]
    got = {r.page_id: r for r in urlgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100].rule is None and got[100].verdict == "block" and got[100].distrust > 0
    assert got[101].rule is None and got[101].verdict == "allow" and got[101].trust > 0
    edges = {(r.src, r.dst) for r in urlgraph.host_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {("w0.bad.org", "w0.bad.org"), ("w0.bad.org", "bad.org"), ("bad.org", "w0.bad.org")} <= edges and ("bad.org", "org") not in edges


def test_names_under_a_registry_share_no_reputation(spark):
    rules = (("block", "a0.co.uk", "/"), ("block", "a1.co.uk", "/"))
    rows = [(i, f"http://{w}a{i}.co.uk/p", '<a href="/x">y</a>') for i in range(20) for w in ("", "blog.")]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)] + [(100, "http://shop.a0.co.uk/", None), (101, "http://x.b.de/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.src, r.dst) for r in urlgraph.host_edges(pages).collect()}
    assert ("blog.a3.co.uk", "a3.co.uk") in edges and ("x.b.de", "b.de") in edges and not any("co.uk" in e for e in edges)
    got = {r.host: r.verdict for r in urlgraph.judge_urls(pages, rules=rules).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"a0.co.uk", "a1.co.uk", "blog.a0.co.uk", "blog.a1.co.uk", "shop.a0.co.uk"}


# 7 mixing


def targets_of(sizes):
    """Resharing by rounds, as stated."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(spark, documents, local, odd, empty):
    for docs in (documents, odd):
        rows = docs.select("doc_id", "source").distinct().toPandas()
        got = mixing.plan_mixture(docs).toPandas()
        again = mixing.plan_mixture(docs).toPandas()
        cols = ["doc_id", "size", "taken", "passes"]
        assert got[cols].sort_values(cols).values.tolist() == again[cols].sort_values(cols).values.tolist() or got[cols].isna().any().any()
        assert (got.taken <= 2 * got["size"]).all()
        assert len(got) == docs.count()
        if docs is documents:
            full = got.merge(rows, on="doc_id")
            sizes = full.groupby("source")["size"].sum().to_dict()
            expected = targets_of(sizes)
            for s, part in full.groupby("source"):
                assert abs(part.target.iloc[0] - expected[s]) < 1e-6
                assert abs(part.taken.sum() - expected[s]) <= 1
    assert mixing.plan_mixture(empty).count() == 0


def test_splitting_tree_is_exact(spark, documents):
    quotas = {f"s{i}": 40 + 30 * i for i in range(7)} | {None: 33}
    got = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 3).toPandas()
    leaves = got.groupby("leaf").places.sum()
    assert len(leaves) == 8 and leaves.max() - leaves.min() <= 3 and leaves.sum() == sum(quotas.values())
    for source, quota in quotas.items():
        part = got[got.source.isna() if source is None else got.source == source].sort_values("begin")
        assert part.begin.tolist() == [0, *part.places.cumsum()[:-1]] and part.places.sum() == quota
        assert abs(part[part.leaf < 4].places.sum() - quota / 2) < 5 * quota**0.5  # a draw's spread
    mixed = mixing.mixed_documents(documents).groupBy("doc_id").count()
    plan = mixing.plan_mixture(documents).where("passes > 0").select("doc_id", "passes")
    assert mixed.join(plan, "doc_id").where("count != passes").count() == 0 and mixed.count() == plan.count()


# 8 quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    chain = np.array([0, 0, 0, 0, 1, 2, 2])
    score, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    good, _, norm = quality_crf._forward_backward(score, chain, moves)
    for c in range(3):
        at = np.flatnonzero(chain == c)
        total, mass = 0.0, np.zeros(len(at))
        for bits in np.ndindex(*[2] * len(at)):
            p = np.exp(sum(score[i] * b for i, b in zip(at, bits, strict=True)) + sum(moves[a, b] for a, b in zip(bits, bits[1:], strict=False)))
            total += p
            mass += p * np.array(bits)
        assert np.allclose(good[at], mass / total) and np.isclose(norm[c], np.log(total))


def test_held_out_quality(spark, documents, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_crf.train(documents, labels)
    got = quality_crf.score_documents(documents, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.85
    assert got.score.between(0, 1).all()
    few = quality_crf.score_documents(odd, model).collect()
    assert len(few) == 10 and all(0 <= r.score <= 1 for r in few)
    assert quality_crf.score_documents(empty, model).count() == 0
    blank = quality_crf.train(empty, labels)
    assert len(quality_crf.score_documents(odd, blank).collect()) == 10


def test_long_texts_are_learned_from(spark):
    good = "The river rises in the hills, and the town below it keeps a careful record of every flood.\n"
    bad = "$$$ CLICK!!! #win# @@@ 99 99 99\n"
    rows = [(i, (good if i % 2 else bad) * (1100 if i % 2 else 3100), "en", "a") for i in range(40)]  # 96 KB each, over LINES lines
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    model = quality_crf.train(docs, labels)
    assert np.abs(model.weights).max() > 0
    assert all(r.predicted == r.doc_id % 2 for r in quality_crf.score_documents(docs, model).collect())


# 9 near-duplicates


def slow_probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def test_exact_similarity_and_its_estimate():
    rng = np.random.default_rng(3)
    for weights in (1, 6):
        a = {int(i): int(rng.integers(1, weights + 1)) for i in rng.choice(300, 200, replace=False)}
        b = {int(i): int(rng.integers(1, weights + 1)) for i in rng.choice(300, 220, replace=False)}
        arr = lambda x: (np.array(sorted(x), np.uint64), np.array([x[i] for i in sorted(x)], np.int64))
        exact = probminhash.probability_jaccard(*arr(a), *arr(b))
        assert abs(exact - slow_probability_jaccard(a, b)) < 1e-9
        element = np.concatenate([arr(a)[0], arr(b)[0]])
        from corpuslens.llm.common import mix

        sig = probminhash.signatures(
            np.repeat([0, 1], [len(a), len(b)]), mix(element + np.uint64(9)), np.concatenate([arr(a)[1], arr(b)[1]]).astype(float), 2, 4096
        )
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def brute_classes(texts):
    sets, at = {}, defaultdict(list)
    for i, t in texts.items():
        w = W.findall(t or "")
        if w:
            sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
            for s in sets[i]:
                at[s].append(i)
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in at[x] if j < i}:
            small = len(s.keys() & sets[j].keys()) / max(len(s), len(sets[j]))
            if small >= 0.5 and slow_probability_jaccard(s, sets[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_cross_links_match_pairs(spark, monkeypatch):
    """Blocks compare every pair of different labels once, weighted or not, whatever the blocks' and tables' bounds."""
    monkeypatch.setattr(probminhash, "BLOCK", 7)
    monkeypatch.setattr(probminhash, "COLUMNS", 16)
    rng = np.random.default_rng(5)
    core, sets = np.sort(rng.choice(10_000, 60, False)).astype(np.uint64), []
    for i in range(40):
        own = np.unique(np.concatenate([rng.choice(core, rng.integers(45, 61), False), rng.integers(10_000, 99_999, rng.integers(0, 9)).astype(np.uint64)]))
        sets.append((own, np.ones(len(own), np.int64) if i % 2 else rng.integers(1, 3, len(own))))
    label = [i % 5 for i in range(40)]
    names = [bytes([i]) for i in range(40)]
    texts = spark.createDataFrame([(n, h.tobytes(), b"" if w.max() == 1 else w.tobytes(), len(h)) for n, (h, w) in zip(names, sets)], "key binary, shingles binary, counts binary, n_shingles long")
    rows = spark.createDataFrame([(1, n, bytes([x])) for n, x in zip(names, label)], "band long, key binary, label binary")
    got = {frozenset(r) for r in probminhash.cross_links(rows, texts, 0.8).collect()}
    sims = {(i, j): probminhash.probability_jaccard(*sets[i], *sets[j]) for i in range(40) for j in range(i)}
    expected = {frozenset([names[i], names[j]]) for (i, j), x in sims.items() if label[i] != label[j] and x >= 0.8}
    assert got == expected and expected
    shared, share = probminhash._overlaps(*map(list, zip(*sets)))
    assert all(x <= min(share[i, j], share[j, i]) + 1e-9 for (i, j), x in sims.items())
    assert all(shared[i, j] == len(np.intersect1d(sets[i][0], sets[j][0])) for i, j in sims)


@pytest.mark.parametrize("n", [2, 3, 17, 40])
def test_no_link_of_a_bucket_is_lost(spark, n):
    """Members that lie too far from any one leader, and pairs among them at 0.8 or more: buckets of every size."""
    rng = np.random.default_rng(n)
    base, rows = [f"t{i}" for i in range(150)], []
    for i in range(n):
        words = list(base)
        for j in rng.choice(150, 5, replace=False):
            words[j] = f"u{i}v{j}"
        rows.append((2 * i, " ".join(words)))
        words[rng.integers(0, 150)] = "twin"
        rows.append((2 * i + 1, " ".join(words)))
    got = probminhash.near_duplicates(docs_of(spark, [(i, t, None, None) for i, t in rows])).toPandas()
    assert {r.doc_id: r.class_id for r in got.itertuples()} == brute_classes(dict(rows))


def test_classes_match_brute_force(spark, local, odd, empty):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = list(zip(local.doc_id, local.text, strict=True))[:120]
    for i in range(60):  # one family whose members differ from each other more than from the base
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 4), replace=False):
            words[j] = f"u{i}v{j}"
        rows.append((10_000 + i, " ".join(words)))
    docs = docs_of(spark, [(int(i), t, None, None) for i, t in rows])
    got = probminhash.near_duplicates(docs).toPandas()
    expected = brute_classes({int(i): t for i, t in rows})
    assert {r.doc_id: r.class_id for r in got.itertuples()} == expected
    assert got.groupby("class_id").keep.sum().eq(1).all()
    left = probminhash.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == got.class_id.nunique()
    few = probminhash.near_duplicates(odd).toPandas()
    assert len(few) == 10 and few[few.doc_id == 7].keep.sum() <= 1
    assert few.set_index("doc_id").class_id[5] == 4 and few.set_index("doc_id").class_size[3] == 1
    assert probminhash.near_duplicates(empty).count() == 0


# 10 line templates


def test_recurring_templates_are_dropped(spark, odd, empty):
    own = lambda i: " ".join(f"unique{i}w{j}" for j in range(12))
    rows = [(i, f"{own(i)}\nuser {i} logged in from host{i} today\n{own(i + 500)}", "en", "a") for i in range(15)]
    rows += [(100 + i, f"rarely seen line number {i} of few\n{own(i + 900)}", "en", "a") for i in range(5)]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in linetree.line_report(docs).collect()}
    assert all(got[i].dropped == "1" and got[i].n_lines == 3 for i in range(15))
    assert all(got[100 + i].n_dropped == 0 for i in range(5))
    clean = {r.doc_id: r.text for r in linetree.cleaned_documents(docs).collect()}
    assert clean[3] == f"{own(3)}\n{own(503)}" and clean[101] == rows[16][1]
    assert len(linetree.line_report(odd).collect()) == 10
    assert linetree.line_report(empty).count() == 0


def test_recurring_lines_of_a_frequent_leaf_are_dropped(spark):
    rows = [(i, "user name is " + " ".join(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}x{j}".replace(str(j), "abcdefg"[j]) for j in range(5)), "en", "a") for i in range(676)]
    rows += [(1000 + i, "user name is missing from the signed form\nuser name is given at the front desk", "en", "a") for i in range(12)]
    got = {r.doc_id: r for r in linetree.line_report(docs_of(spark, rows)).collect()}
    assert all(got[1000 + i].dropped == "0,1" and got[1000 + i].n_dropped == 2 for i in range(12))
    assert all(got[i].n_dropped == 0 for i in range(676))


def test_templates_match_brute_force(spark, documents, local):
    """Leaves, supports, templates and their documents by plain dictionaries."""
    mask = lambda w: "<v>" if re.search("[0-9]", w) else w
    lines = [(i, n, tuple(mask(w) for w in W.findall(x))) for i, t in zip(local.doc_id, local.text, strict=True) for n, x in enumerate(t.split("\n"))]
    lines = [(i, n, x, (len(x), x[:3])) for i, n, x in lines if len(x) >= linetree.MIN_TOKENS]
    docs_in, rows_in, support = defaultdict(set), Counter(), Counter()
    for i, _, x, leaf in lines:
        docs_in[leaf].add(i)
        rows_in[leaf] += 1
        support.update((leaf, p, w) for p, w in enumerate(x))
    recur = defaultdict(set)
    templates = {}
    for i, n, x, leaf in lines:
        if len(docs_in[leaf]) < 10:
            continue
        held = [(p, w) for p, w in enumerate(x) if w != "<v>" and support[leaf, p, w] >= 10]
        wide = [(p, w) for p, w in held if support[leaf, p, w] >= 0.02 * rows_in[leaf]]
        templates[i, n] = {(leaf, tuple(f)) for f in (held, wide) if f and len(f) >= 0.6 * len(x)}
        for t in templates[i, n]:
            recur[t].add(i)
    gone = {k for k, v in templates.items() if any(len(recur[t]) >= 10 for t in v)}
    got = {(r.doc_id, int(n)) for r in linetree.line_report(documents).collect() for n in r.dropped.split(",") if n}
    assert got == gone and gone


# every operator

CLASHES = ["mix", "mix_pass", "mix_shard", "gone", "gone_id", "gone_lines", "d", "p", "x", "draw", "size", "k", "key", "band", "row", "number", "place", "lines", "fit", "words", "leaf", "words_gone", "bad_id", "host"]


def test_clashing_columns_and_text_keys(spark):
    """Tables of documents with columns that operators use inside, and with keys that are texts."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    plain = spark.createDataFrame([(i, f"words of row {i} are here for all " + "to read and keep " * (i % 4), "en", "a") for i in range(12)] + [(99, None, None, None)], "doc_id long, text string, lang string, source string")
    wide = plain.select("*", *[F.lit(1).alias(c) for c in CLASHES])
    for docs in (wide.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string"))),):
        n = docs.count()
        for out in (langid.accepted(docs), probminhash.deduplicated(docs), decontam.decontaminated(docs, bench), mixing.mixed_documents(docs), linetree.cleaned_documents(docs), line_rules.cleaned_documents(docs)):
            assert out.columns == docs.columns and out.count() <= 2 * n
        for out in (sharding.shard_records(docs), pii.scan_documents(docs), line_rules.line_verdicts(docs), langid.identify(docs), mixing.plan_mixture(docs), probminhash.near_duplicates(docs), linetree.line_report(docs), pii.masked_documents(docs)):
            assert out.count() == n


def test_repeated_rows_keep_the_mix_at_its_target(spark):
    rows = [(i % 10, "w " * (i % 10 + 5), "en", "a" if i % 10 < 4 else "b") for i in range(100)]
    docs = docs_of(spark, rows)
    plan = mixing.plan_mixture(docs).toPandas()
    mixed = mixing.mixed_documents(docs)
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == plan.taken.sum()
    assert abs(plan.taken.sum() - 1.5 * plan["size"].sum()) <= 2 * 10 * 2  # equal rows share what is left at each source's end


# the pipeline


def test_pipeline_stages_take_effect(spark, documents):
    import corpus_pipeline

    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == counts[3] and set(r.shard for r in last.select("shard").distinct().collect()) <= set(range(8))
    assert isinstance(last.schema, T.StructType)
