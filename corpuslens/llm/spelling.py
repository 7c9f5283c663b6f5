"""Groups of spelling variants by pivotal grams.

Two words at one edit share one of the two disjoint rare bigrams (pivots) that each of them chooses: an edit touches one
of two disjoint bigrams at most.  The pivots of one word are looked up in the gram prefixes of the others, at positions
that one edit allows, and what is found is verified.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, written

#: Runs of letters; fixed values.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
#: Edits that make two words near, letters of a gram: a word has EDITS + 1 pivots among GRAM * EDITS + 1 prefix grams.
EDITS, GRAM = 1, 2
#: A word is a variant of a near word that is this often as frequent.
RATIO = 5
#: ``n`` grows by RATIO from a word to its form, so a chain of forms has fewer than 28 words: five doublings reach its end.
DOUBLINGS = 5
SIDES = "key long, word string, n long, last int, pivot boolean"


def lower_ascii(word: Column) -> Column:
    """Only A to Z in lower case; words of plain ASCII take the fast function."""
    slow = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(slow)


def without_letter(doc: Column, word: Column, every: int) -> Column:
    """``word`` less the code point at h % length if ``every`` divides h, the CRC-32 of ``doc:word``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5, drop_every: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters of whole texts with their occurrences, once ``drop_every`` has taken letters from some.

    Null and empty texts have no words; a null key counts as an empty string; rows that repeat count each time.  Words
    are counted in each task before they are shuffled, so a word in a third of all texts is as cheap as any.
    """
    run = F.explode(F.regexp_extract_all(text, F.lit(RUN % least_chars), F.lit(0)))
    found = docs.select(F.col(key).alias("doc"), run.alias("run")).select("doc", lower_ascii(F.col("run")).alias("word"))
    if drop_every:
        found = found.select(without_letter(F.col("doc"), F.col("word"), drop_every).alias("word"))
        found = found.where(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each gram, rarest first, ties by code point: one row for each pair of letters, 8,100 at most."""
    at = F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def prefix(word: str, ranks: dict[str, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The GRAM * EDITS + 1 rarest grams of a word as (position, rank), and these with all that tie with the last."""
    grams = sorted((ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    first = grams[: GRAM * EDITS + 1]
    return [(i, r) for r, i in first], [(i, r) for r, i in grams if r <= first[-1][0]]


def pivots(grams: list[tuple[int, int]], wanted: int = EDITS + 1) -> list[tuple[int, int]]:
    """The ``wanted`` disjoint grams of least total rank, by dynamic programming over positions.

    ``best[k]`` holds the cheapest k disjoint grams among those seen; a gram extends what ends GRAM letters before it.
    """
    grams = sorted(grams)
    rows: list[list[tuple[int, list] | None]] = [[(0, [])] + [None] * wanted]
    for j, (at, rank) in enumerate(grams):
        before = sum(1 for i, _ in grams[:j] if i + GRAM <= at)
        row = list(rows[-1])
        for k in range(1, wanted + 1):
            left = rows[before][k - 1]
            if left is not None and (row[k] is None or left[0] + rank < row[k][0]):
                row[k] = (left[0] + rank, [*left[1], (at, rank)])
        rows.append(row)
    return rows[-1][wanted][1]


def index_keys(word: str, grams: list[tuple[int, int]]) -> Iterator[tuple]:
    """(gram rank, position, length, half, its letters) of each prefix gram: lists are split by both halves of the word."""
    size, half = len(word), len(word) // 2
    for at, rank in grams:
        yield rank, at, size, 0, word[:half]
        yield rank, at, size, 1, word[half:]


def probe_keys(word: str, chosen: list[tuple[int, int]]) -> Iterator[tuple]:
    """Keys under which a near word lists a pivot of ``word``.

    With ``d`` letters more than ``word`` the near word has the gram at the same place, or moved by ``d``; its first half
    is that of ``word`` if the edit lies behind it, else its second half is.  A gram within the half that stays moves with it.
    """
    size = len(word)
    for at, rank in chosen:
        for d in (-1, 0, 1):
            other = size + d
            half = other // 2
            for there in {at, at + d}:
                if not 0 <= there <= other - GRAM:
                    continue
                if there + GRAM > half or there == at:
                    yield rank, there, other, 0, word[:half]
                if there < half or there == at + d:
                    yield rank, there, other, 1, word[size - (other - half) :]


def _signatures(ranks: dict[str, int]):
    import xxhash

    def hashed(key: tuple) -> int:
        return xxhash.xxh64_intdigest("\x00".join(map(str, key))) - (1 << 63)

    def run(batches):
        for batch in batches:
            keys, at, last, kind = [], [], [], []
            for i, word in enumerate(batch["word"].to_pylist()):
                first, all_first = prefix(word, ranks)
                for pivot, found in ((False, index_keys(word, all_first)), (True, probe_keys(word, pivots(first)))):
                    new = [hashed(k) for k in found]
                    keys += new
                    at += [i] * len(new)
                    last += [first[-1][1]] * len(new)
                    kind += [pivot] * len(new)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch["word"].take(at), batch["n"].take(at), pa.array(last, pa.int32()), pa.array(kind, pa.bool_())],
                names=["key", "word", "n", "last", "pivot"],
            )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` of all pairs of different words at one inserted, deleted or replaced code point, both ways.

    ``words(word, n)`` holds distinct words of three grams or more.  Of two near words, a pivot of the one whose prefix
    ends with the rarer gram is in the prefix of the other, so only those lists are read.  Lists are split by the half of
    the word that an edit leaves whole: a gram that a third of all words hold gives no list of that size.
    """
    sides = written(arrow_map(words.select("word", "n"), _signatures(gram_ranks(words)), SIDES), "grams")
    asked = sides.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("last").alias("alast"))
    listed = sides.where("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("blast"))
    met = asked.join(listed, "key").where("alast <= blast and a != b and levenshtein(a, b, 1) = 1")
    low = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    pairs = met.select(pick("a", "b").alias("a"), pick("an", "bn").alias("an"), pick("b", "a").alias("b"), pick("bn", "an").alias("bn")).distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    return pairs.select(ends.alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the last word that following forms reaches.  Doubles its steps five times."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        reached = written(reached, "roots")
        ahead = reached.select(F.col("word").alias("via"), F.col("root").alias("further"))
        reached = reached.join(ahead, reached.root == ahead.via, "left").select("word", F.coalesce("further", "root").alias("root"))
    return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words(word, n)``.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is ``ratio`` times its own n
    or more, else null; a word without form is its own root.  An empty table gives none.
    """
    words = written(words, "words")
    first = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    taken = words.join(first, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = taken.withColumn("fits", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    taken = written(
        taken.select(
            "word",
            F.when(F.col("fits"), F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("fits"), F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    return taken.join(roots(taken.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
