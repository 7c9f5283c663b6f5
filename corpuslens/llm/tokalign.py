"""Alignment of two tokenizers over a corpus, with external counts of linked id pairs.

A text is cut where the byte ranges of both tokenizers' tokens end.  Tasks sort the (id pair, document) records of a block
of documents, partition them by the radix of the B id and store each part as a zstd run.  A heap merges the runs of a
radix in B-major order, which counts each pair and gives the highest count of each B id as it passes; the runs are then
read again and the counts go back to their documents.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, key_type, written

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts of a block's records, by the B id; runs that a heap merges at once.
RADIX, FAN_IN = 64, 64
#: Most documents of a block, and records after which a block is sorted and stored.
BLOCK_DOCS, BLOCK_RECORDS = 1 << 14, 1 << 22
#: Stored bytes of a radix that one task reads back.
LANE_BYTES = 64 << 20
#: Characters of a text that are cut into segments at once, and segments whose alignment a task keeps.
SLICE, KEPT = 1 << 20, 400_000
#: Characters of new segments that are encoded at once.
RUN_CHARS = 1 << 12

#: A space between two characters that are no white space: tokens of both kinds end before it.
_CUT = re.compile("(?<=[^\\s᠎​])\x20(?=[^\\s᠎​])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the alignment of the segments seen so far."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_letters()
        self.size = self.a.get_vocab_size()
        self.a_bytes = [b""] * self.size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        one = [_BYTE_PIECE.fullmatch(piece) for piece in pieces]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode() for m, piece in zip(one, pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        #: Ids as text with what follows: the next id of the same side, the other side, the next group.
        self.a_text = [[f"{i},", f"{i}|"] for i in range(self.size)]
        self.b_text = [[f"{i},", f"{i};"] for i in range(len(pieces))]
        # a piece that goes on after a letter with a space would cross the cuts
        self.cuts = not any("▁" in piece.lstrip("▁") for piece in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.ends, self.codes = array("q"), array("q", [0]), array("q")

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both, and whether both give the bytes of space + text."""
        a, b, whole = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1), (" " + text).encode()
        same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
        return np.array(a, np.int64), np.array(b, np.int64), same

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens as text in the order of groups, then as arrays: ends of that text's tokens, links' codes and ends, groups' ends; ends are bytes.

        A link is a stretch between two neighbouring ends of either side: it lies in one token of each, and no other
        stretch lies in the same two.  A group ends where both sides do.
        """
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        stops = np.union1d(a_ends, b_ends)
        codes = b[np.searchsorted(b_ends, stops)] * self.size + a[np.searchsorted(a_ends, stops)]
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_a, last_b = np.isin(a_ends, cuts, assume_unique=True).astype(int), np.isin(b_ends, cuts, assume_unique=True).astype(int)
        text = [self.a_text[i][last] for i, last in zip(a.tolist(), last_a.tolist())] + [self.b_text[i][last] for i, last in zip(b.tolist(), last_b.tolist())]
        group = np.concatenate([np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)])
        side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        order = np.lexsort((np.arange(len(group)), side, group))
        return [text[i] for i in order.tolist()], cuts[group[order]], codes, stops, cuts, a_ends

    def learn(self, segments: Iterable[str]) -> None:
        """Aligns segments that aren't known: sizes are tokens of A and B, groups, links; -1 where bytes differ.

        Segments without outer white space are encoded in runs with single spaces between them, where they were cut.
        """
        new = list(dict.fromkeys(s for s in segments if s not in self.known))
        run, size = [], 0
        for segment in new:
            if not segment or segment[0].isspace() or segment[-1].isspace() or len(segment) > RUN_CHARS:
                self._add([segment])
                continue
            run.append(segment)
            size += len(segment)
            if size > RUN_CHARS:
                self._add(run)
                run, size = [], 0
        if run:
            self._add(run)

    def _add(self, run: list[str]) -> None:
        a, b, same = self.encoded(" ".join(run))
        if not same:
            if len(run) > 1:
                for segment in run:
                    self._add([segment])
            else:
                self._keep(run[0], "", (-1, 0, 0, 0), [])
            return
        text, text_ends, codes, stops, cuts, a_ends = self.align(a, b)
        b_ends = np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(s.encode()) + 1 for s in run])
        at = [np.searchsorted(x, ends, side="right").tolist() for x in (text_ends, a_ends, b_ends, cuts, stops)]
        was = [0] * 5
        codes = codes.tolist()
        for segment, *now in zip(run, *at):
            self._keep(segment, "".join(text[was[0] : now[0]])[:-1], [n - w for n, w in zip(now[1:], was[1:])], codes[was[4] : now[4]])
            was = now

    def _keep(self, segment: str, groups: str, sizes, codes: list[int]) -> None:
        self.known[segment] = len(self.groups)
        self.groups.append(groups)
        self.sizes.extend(sizes)
        self.codes.extend(codes)
        self.ends.append(len(self.codes))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Sizes, digest of the groups, codes and their numbers for each text; no tokens where bytes differ."""
        for text in texts:
            done = self._document(text) if text and self.cuts else None
            if done is None:
                done = self._whole(text) if text else NOTHING
            yield done

    def _whole(self, text: str):
        a, b, same = self.encoded(text)
        if not same:
            return NOTHING
        words, _, codes, _, cuts, _ = self.align(a, b)
        return (len(a), len(b), len(cuts), len(codes)), hashlib.sha256("".join(words)[:-1].encode()).hexdigest(), *np.unique(codes, return_counts=True)

    def _document(self, text: str):
        total, digest, parts = np.zeros(4, np.int64), hashlib.sha256(), []
        for n, segments in enumerate(segmented(text)):
            at = list(map(self.known.get, segments))
            if None in at:
                if len(self.known) > KEPT:
                    self.forget()
                self.learn(segments)
                at = [self.known[s] for s in segments]
            digest.update((";" if n else "").encode() + ";".join([self.groups[i] for i in at]).encode())
            at = np.array(at)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ids, times = at[first], np.diff(np.append(first, len(at)))
            sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 4)[ids]
            if (sizes[:, 0] < 0).any():
                return None  # looked at as a whole
            total += times @ sizes
            starts, links = np.frombuffer(self.ends, np.int64)[ids], sizes[:, 3]
            flat = np.repeat(starts - np.cumsum(links) + links, links) + np.arange(links.sum())
            parts.append((np.frombuffer(self.codes, np.int64)[flat], np.repeat(times, links)))
        codes, times = np.concatenate([c for c, _ in parts]), np.concatenate([t for _, t in parts])
        return tuple(int(x) for x in total), digest.hexdigest(), *summed(codes, times)


NOTHING = ((0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def segmented(text: str) -> Iterator[list[str]]:
    """Segments of a text: cut at spaces that begin a token of either kind, which are left out."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        yield _CUT.split(text[at:end])
        at = end + 1


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


@cache
def aligner(folder: str) -> Aligner:
    return Aligner(folder)


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one zstd frame."""
    import zstandard

    head = np.array([len(c) for c in columns], np.int64).tobytes() + b"".join(c.dtype.str.encode() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(columns)]) + head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(frame: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = raw[0]
    sizes = np.frombuffer(raw, np.int64, n, 1)
    at, out = 1 + 11 * n, []
    for i, size in enumerate(sizes):
        kind = np.dtype(raw[1 + 8 * n + 3 * i : 4 + 8 * n + 3 * i].decode())
        out.append(np.frombuffer(raw, kind, size, at))
        at += int(size) * kind.itemsize
    return out


def _runs(codes: np.ndarray, docs: np.ndarray, times: np.ndarray, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted runs of a block: radix, directory (pairs, documents, links of each), postings (documents, links of each)."""
    radix = (codes // size) % RADIX
    order = np.lexsort((docs, codes, radix))
    codes, docs, times, radix = codes[order], docs[order], times[order], radix[order]
    borders = np.searchsorted(radix, np.arange(RADIX + 1))
    for r in range(RADIX):
        lo, hi = borders[r], borders[r + 1]
        if lo == hi:
            continue
        c, t = codes[lo:hi], times[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        length = np.diff(np.append(first, len(c)))
        yield r, packed(c[first], length.astype(np.int32), np.add.reduceat(t, first)), packed(docs[lo:hi].astype(np.uint16), t.astype(np.uint32))


BASE = ["n_a", "n_b", "n_groups", "n_links"]


def _spilled(folder: str):
    def run(batches):
        tools, part, block, size = aligner(folder), TaskContext.get().partitionId(), 0, aligner(folder).size
        held, n_docs, n_records, doc_type = [], 0, 0, None

        def rows(doc_ids, sizes, digests, firsts) -> pa.RecordBatch:
            n = len(digests)
            cols = [pa.array(firsts, pa.int64()), doc_ids]
            cols += [pa.array([s[i] for s in sizes], pa.int64()) for i in range(4)]
            cols += [pa.array(digests, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=NAMES)

        def flushed() -> Iterator[pa.RecordBatch]:
            docs = np.repeat(np.array([i for i, _, _ in held]), [len(c) for _, c, _ in held])
            for r, directory, postings in _runs(np.concatenate([c for _, c, _ in held]), docs, np.concatenate([t for _, _, t in held]), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, doc_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.array([(part << 24) + block], pa.int64()),
                     pa.array([r], pa.int32()), pa.array([directory], pa.binary()), pa.array([postings], pa.binary())],
                    names=NAMES,
                )

        for batch in batches:
            doc_type = batch["doc_id"].type
            sizes, digests, firsts, start = [], [], [], 0
            for i, (size4, digest, codes, times) in enumerate(tools.documents(batch["text"].to_pylist())):
                sizes.append(size4)
                digests.append(digest)
                firsts.append((((part << 24) + block) << 14) + n_docs)
                if len(codes):
                    held.append((n_docs, codes, times))
                n_docs, n_records = n_docs + 1, n_records + len(codes)
                if n_docs == BLOCK_DOCS or n_records >= BLOCK_RECORDS:
                    yield rows(batch["doc_id"][start : i + 1], sizes, digests, firsts)
                    if held:
                        yield from flushed()
                    sizes, digests, firsts, start = [], [], [], i + 1
                    held, n_docs, n_records, block = [], 0, 0, block + 1
            if digests:
                yield rows(batch["doc_id"][start:], sizes, digests, firsts)
        if held:
            yield from flushed()

    return run


NAMES = ["row", "doc_id", *BASE, "groups_sha256", "block", "radix", "directory", "postings"]


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """k-way heap merge of sorted (pair, links) runs: links of equal pairs are summed as they pass."""
    pairs, counts, last = array("q"), array("q"), -1
    for pair, links in heapq.merge(*[zip(p.tolist(), c.tolist()) for p, c in runs], key=lambda entry: entry[0]):
        if pair == last:
            counts[-1] += links
        else:
            pairs.append(pair)
            counts.append(links)
            last = pair
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def _counted(size: int):
    """Merges the directories of each radix, FAN_IN at once, and flags the pairs that reach their B id's highest count."""

    def finished(radix: int, waiting: list) -> pa.RecordBatch:
        pairs, counts = _merged(waiting) if len(waiting) > 1 else waiting[0]
        side = pairs // size
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([packed(pairs, counts, (counts == highest).astype(np.int8))], pa.binary())], names=["radix", "counts"])

    def run(batches):
        now, waiting = None, []
        for batch in batches:
            for radix, frame in zip(batch["radix"].to_pylist(), batch["directory"]):
                if radix != now:
                    if waiting:
                        yield finished(now, waiting)
                    now, waiting = radix, []
                pairs, _, links = unpacked(frame.as_py())
                waiting.append((pairs, links))
                if len(waiting) == FAN_IN:
                    waiting = [_merged(waiting)]
        if waiting:
            yield finished(now, waiting)

    return run


def _contributions(batches):
    """Streams each run's postings past the counts of its radix: what every document of the block gains there."""
    stats = None
    for batch in batches:
        for radix, block, counts, directory, postings in zip(*[batch[c] for c in ("radix", "block", "counts", "directory", "postings")]):
            if counts.is_valid:
                stats = unpacked(counts.as_py())
                continue
            pairs, length, _ = unpacked(directory.as_py())
            docs, times = unpacked(postings.as_py())
            at = np.repeat(np.searchsorted(stats[0], pairs), length)
            times = times.astype(np.int64)
            order = np.argsort(docs, kind="stable")
            docs, gains, best = docs[order], (times * stats[1][at])[order], (times * stats[2][at])[order]
            first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            frame = packed(docs[first], np.add.reduceat(best, first), np.add.reduceat(gains, first))
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([frame], pa.binary())], names=["block", "gained"])


def _summed_block(table: pa.Table) -> pa.Table:
    """Sums the contributions of a block's runs, RADIX of them at most."""
    best, gains = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
    for frame in table["gained"]:
        docs, b, g = unpacked(frame.as_py())
        best[docs] += b
        gains[docs] += g
    docs = np.flatnonzero(gains)
    return pa.table({"row": pa.array((table["block"][0].as_py() << 14) + docs, pa.int64()), "n_best": pa.array(best[docs]), "count_sum": pa.array(gains[docs])})


def align_documents(docs: DataFrame, folder: str = FOLDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row, over whole texts.

    ``folder`` holds both tokenizers' files on every machine.  Null and empty texts, and texts whose tokens don't give
    back the bytes of space + text, have zeros and an empty digest.  Rows that repeat count each time; a null key stays;
    other columns are left out; an empty table gives none.  Ties for a B id's highest count all count as best.  A pair in
    a third of all records is one entry of each run's directory, and runs of one radix are dealt over lanes by block.
    """
    schema = f"row long, doc_id {key_type(docs, key)}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, radix int, directory binary, postings binary"
    table = written(arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), _spilled(folder), schema), "pair-runs")
    runs, base = table.where("radix is not null"), table.where("row is not null").select("row", "doc_id", *BASE, "groups_sha256")
    size = aligner(folder).size

    directories = runs.select("radix", "block", "directory").repartition(RADIX, "radix").sortWithinPartitions("radix", "block")
    counts = written(arrow_map(directories, _counted(size), "radix int, counts binary"), "pair-counts")

    stored = runs.agg(F.sum(F.octet_length("postings"))).first()[0] or 0
    lanes = max(1, math.ceil(stored / RADIX / LANE_BYTES))
    laned = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), "block", F.lit(None).cast("binary").alias("counts"), "directory", "postings")
    nothing = F.lit(None).cast("binary")
    spread = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(None).cast("long").alias("block"), "counts", nothing.alias("directory"), nothing.alias("postings"))
    # the counts of a radix come before its runs: a null block is first
    dealt = spread.unionByName(laned).repartition(RADIX * lanes, "radix", "lane").sortWithinPartitions("radix", "lane", F.col("block").asc_nulls_first())
    gained = written(arrow_map(dealt, _contributions, "block long, gained binary"), "pair-gains")
    sums = gained.groupBy("block").applyInArrow(_summed_block, "row long, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(sums, "row", "left").select("doc_id", *BASE, zero("n_best"), zero("count_sum"), "groups_sha256")
