"""Content-addressed archive, tokenizer alignment and spelling variants against plain Python."""

import collections
import dataclasses
import gzip
import hashlib
import zlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpuslens.llm import spelling, tokalign, warc

LONG = "<p>" + "x" * 2000 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"


def page_rows():
    rows = [(i, f"http://h{i % 3}.org/{i}", LONG) for i in range(60)]  # a group of copies of most rows
    rows += [(100, "http://a.org/", "é" * 600), (101, None, "é" * 600), (102, "http://b.org/\r\nX: 1", "short"), (103, "u", "short")]
    rows += [(104, "u", None), (105, "u", ""), (None, "v", "y" * 1000), (None, None, "y" * 1000), (106, "w", "z" * 999), (107, "w", "z" * 999)]
    return rows + [(108, "t", "t" * 1000)] * 3 + [(109, "s", "s" * (6 << 20))]


def expected_pages(rows):
    groups = collections.defaultdict(list)
    for page, url, html in rows:
        groups[(html or "").encode()].append((page is not None, page or 0, url is not None, url or ""))
    out = collections.Counter()
    for payload, members in groups.items():
        first = max(members)
        for i, m in enumerate(sorted(members, reverse=True)):
            page = m[1] if m[0] else None
            revisit = len(payload) >= 1000 and i > 0
            out[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", (first[1] if first[0] else None) if revisit else None] += 1
    return out


PAGES = "page_id long, url string, html string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("hot", [2, 1024, 1 << 40])
def test_archive_report(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_SHARE", hot)
    monkeypatch.setattr(warc, "COPY_BLOCK", 2)
    pages = spark.createDataFrame(page_rows(), PAGES).withColumn("sha256", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = collections.Counter(tuple(r) for r in warc.archive_report(pages).select(*COLUMNS).collect())
    assert got == expected_pages(page_rows())


def test_archive_empty_and_text_keys(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).count() == 0
    pages = spark.createDataFrame([("a b\n", "u", "q" * 1000), ("ä", "u", "q" * 1000)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_report(pages).collect()} == {("ä", None), ("a b\n", "ä")}


def test_archive_stores_once_and_gives_records_back(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    archive = warc.archived(pages)
    rows = page_rows()
    assert archive.payloads.count() == len({(h or "").encode() for _, _, h in rows})
    back = archive.payloads.count(), collections.Counter(bytes(r.payload).decode() for r in warc.originals(archive).collect())
    assert back[1] == collections.Counter(h or "" for _, _, h in rows)
    read = warc.read_files(spark, warc.write_files(archive, str(tmp_path / "files"))).collect()
    stored = {r.record_id: r.head for r in archive.heads.collect()}
    assert len(stored) == len(rows) == len(read)
    assert all(bytes(r.head) == stored[r.record_id].encode() for r in read)
    assert all(r.refers_to_id in stored for r in read if r.record_type == "revisit")


def test_archive_refuses_damage(spark, tmp_path):
    archive = warc.archived(spark.createDataFrame(page_rows()[-1:], PAGES))
    with pytest.raises(Exception, match="damaged payload"):
        warc.originals(dataclasses.replace(archive, payloads=archive.payloads.withColumn("payload", F.lit("other").cast("binary")))).collect()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    with pytest.raises(PythonException, match="cut off"):
        warc.read_files(spark, str(tmp_path / "cut")).collect()


def test_reads_members_and_other_types(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    two = one.replace(b"uuid:1", b"uuid:2").replace(b"WARC-Type: warcinfo", b"WARC-Type: resource\r\nWARC-Payload-Digest: sha1:ABC")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    read = {r.record_id: (r.record_type, bytes(r.payload)) for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert read == {"urn:uuid:1": ("warcinfo", b"a: b"), "urn:uuid:2": ("resource", b"a: b")}
    assert warc.resolved(warc.read_files(spark, str(tmp_path))).count() == 2


TEXTS = [
    "The cat sat on the mat, the cat.", "The cat", "naïve café — 東京 2024  two  spaces \n lines\t tabs", " leading and trailing ", "a▁b stays out", "<|endoftext|> <s> </s> <0x41>",
    "\x00 control \x1c \x85 x", "don't we'll I'm 12345 67,890", "", None, "   ", "the " * 3000, "supercalifragilistic" * 40, "🙂🙃 é a ́ b   c d",
    "the cat the cat the cat", "The cat",
]


def expected_alignment(texts):
    tools, counts, found = tokalign.Aligner(tokalign.FOLDER), collections.Counter(), []
    for text in texts:
        a = tools.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        parts = [[tools.a_bytes[i] for i in a], [tools.b_bytes[i] for i in b]]
        if not text or not all(b"".join(p) == (" " + text).encode() for p in parts):
            found.append(None)
            continue
        spans = []
        for p in parts:
            ends = [sum(map(len, p[: i + 1])) for i in range(len(p))] if len(p) < 500 else list(__import__("itertools").accumulate(map(len, p)))
            spans.append([(e - len(x), e) for x, e in zip(p, ends)])
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        links = collections.Counter()
        for cut in cuts:
            ga, gb = ([(i, s) for i, s in zip(ids, sp) if lo < s[1] <= cut] for ids, sp in zip((a, b), spans))
            links.update((i, j) for i, s in ga for j, t in gb if max(s[0], t[0]) < min(s[1], t[1]))
            groups.append(",".join(str(i) for i, _ in ga) + "|" + ",".join(str(j) for j, _ in gb))
            lo = cut
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = collections.Counter()
    for (_, j), c in counts.items():
        highest[j] = max(highest[j], c)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            yield (*f[:3], f[3].total(), sum(n for k, n in f[3].items() if counts[k] == highest[k[1]]), sum(n * counts[k] for k, n in f[3].items()), f[4])


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    texts = TEXTS + ["The cat sat " + w for w in "on by at in it".split()]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("row", F.lit(7)).withColumn("radix", F.lit("x")).repartition(3)
    if small:  # the worker reads the modules anew, so limits are set where they are read
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        monkeypatch.setattr(tokalign, "LANE_BYTES", 10)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in tokalign.align_documents(docs).select(*columns).collect()), key=lambda r: (r[0] is not None, r[0]))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i if i else None, *e) for i, e in enumerate(expected_alignment(texts))]


def test_alignment_empty_and_text_keys(spark):
    assert tokalign.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = tokalign.align_documents(spark.createDataFrame([("k", "one two"), ("k", "one two")], "doc_id string, text string")).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_best == twice[0].n_links and twice[0].count_sum == 2 * twice[0].n_links


def test_segments_give_whole_texts_tokens(monkeypatch):
    tools = tokalign.Aligner(tokalign.FOLDER)
    whole = list(tokalign.Aligner._whole(tools, t) for t in TEXTS if t)
    monkeypatch.setattr(tokalign, "SLICE", 5)
    monkeypatch.setattr(tokalign, "KEPT", 3)
    for text, w in zip([t for t in TEXTS if t], whole):
        cut = tools._document(text)
        if cut is not None:
            assert cut[:2] == w[:2] and cut[2].tolist() == w[2].tolist() and cut[3].tolist() == w[3].tolist()


def test_blocks_and_merges():
    """Runs of several blocks: counts come from a merge of more runs than the heap takes at once."""
    import numpy as np

    rng, size = np.random.default_rng(3), 50
    blocks = [(rng.integers(0, 2000, 300), rng.integers(0, 40, 300), rng.integers(1, 4, 300)) for _ in range(150)]
    directories, truth = collections.defaultdict(list), collections.Counter()
    for codes, docs, times in blocks:
        for c, t in zip(codes.tolist(), times.tolist()):
            truth[c] += t
        for r, directory, postings in tokalign._runs(codes, docs, times, size):
            directories[r].append(directory)
            assert sum(tokalign.unpacked(directory)[2]) == sum(tokalign.unpacked(postings)[1])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"radix": [r] * len(d), "directory": d}) for r, d in sorted(directories.items())]
    found, best = {}, set()
    for batch in tokalign._counted(size)(batches):
        for frame in batch["counts"]:
            pairs, counts, top = tokalign.unpacked(frame.as_py())
            found |= dict(zip(pairs.tolist(), counts.tolist()))
            best |= set(pairs[top == 1].tolist())
    assert found == dict(truth)
    assert best == {p for p in truth if truth[p] == max(truth[q] for q in truth if q // size == p // size)}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(words):
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in around.items():
        if found:
            top = min(found, key=lambda v: (-words[v], v))
            if words[top] >= 5 * words[w]:
                form[w] = top
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(around[w]), words.get(form.get(w))))
    return out


VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_of_dense_words(spark):
    import random

    random.seed(5)
    words = {}
    for stem in ("aaaaaa", "ababab", "banana", "zebras", "naïveté", "aaaaaaa"):
        for _ in range(60):
            w = list(stem)
            for _ in range(random.randint(0, 3)):
                i = random.randrange(len(w))
                w[i : i + random.randint(0, 1)] = random.choice(["a", "b", "é", "ab"])
            w = "".join(w)
            if len(w) >= 6:
                words[w] = random.choice([5, 6, 25, 30, 125, 700])
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).select(*VARIANTS).collect()
    assert {tuple(r) for r in got} == expected_variants(words)


def test_words_lose_letters(spark):
    rows = [(i, "Zürich ZÜRICH Wörterbuch wörterbuch straße×÷ Éclair abcdef ABCDEF x") for i in range(400)] + [(None, "wanderer " * 300), (1, None), (2, "")]
    words = collections.Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    import re

    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("q")).withColumn("n", F.lit(9))
    got = spelling.word_counts(docs, drop_every=199)
    assert {(r.word, r.n) for r in got.collect()} == set(words.items())
    assert {tuple(r) for r in spelling.variants(got).select(*VARIANTS).collect()} == expected_variants(words)


def test_variants_empty_and_ties(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    words = {"letter": 5, "lettes": 50, "letteq": 50, "ketter": 24}
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["letter"] == ("letteq", 3) and got["ketter"] == (None, 1)


def test_pivots_are_the_cheapest_disjoint_grams():
    from itertools import combinations

    grams = [(0, 4), (1, 1), (2, 3), (5, 9), (6, 2)]
    best = min((c for c in combinations(grams, 2) if abs(c[0][0] - c[1][0]) >= 2), key=lambda c: c[0][1] + c[1][1])
    assert set(spelling.pivots(grams)) == set(best)
