"""Spelling variants of a corpus's words, found by permuterm rotations.

A word with a terminator after it is rotated so that the place of an edit comes last:
`acb` edited at `c` gives the prefix `b$a` and the skipped character `c`, `ab` open at the
same place gives `b$a` and nothing. All rotations are sorted by prefix; words that share
one differ by exactly one replaced, inserted or deleted character, and as each is told
from the others by its skipped character, a prefix has no more words than the alphabet
has letters. One scan over the sorted rows emits, for each word of such a run, how many
neighbours it has there and which one is the most frequent, so rows stay in proportion to the
letters of all words, not to the pairs.

Words longer than LONG code points are compared in the same way by a 127-bit number of
each prefix instead of the prefix, which a long word would have as often as it has letters.

Null texts have no words; a null id counts as empty text in the hash that garbles runs.
Repeated rows count as often as they come, other columns are not carried, and a table
without words gives no rows. Texts are read whole; what a task holds is one text's words
and MEMO counts at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import read_table
from .workspace import cut

#: Distinct words that a task counts before it passes them on.
MEMO = 400_000
#: Code points of a word beyond which prefixes are compared by number.
LONG = 64
END = "$"
# The contract's letters, what garbles a run, and what makes a word a variant.
LETTERS = "[a-zÀ-ÿ]+"
GARBLE = 199
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 6, 5, 5

_PRIME = (1 << 127) - 1
_BASE = pow(3, 1001, _PRIME)


def garbled(run: str, h: int) -> str:
    """The run without its code point h % length, where GARBLE divides h."""
    if h % GARBLE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of enough letters and occurrences."""
    find = re.compile(LETTERS).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(find((text or "").encode().lower().decode())).items():
                    word = garbled(word, zlib.crc32(word.encode(), start))
                    if len(word) >= least_letters:
                        seen[word] += n
                if len(seen) >= MEMO:
                    yield out()
        yield out()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(word: str) -> Iterator[tuple[str, str]]:
    """(prefix, skipped character or nothing) of a word's edits."""
    size, twice = len(word), (word + END) * 2
    for k in range(size):
        yield twice[k : k + size + 1], ""
        yield twice[k + 1 : k + 1 + size], word[k]
    yield twice[size : size + size + 1], ""


def numbered_rotations(word: str) -> Iterator[tuple[str, str]]:
    """The same with a number for each prefix, of its letters in a base and of its length; the time is in proportion to the letters."""
    size, text = len(word), (word + END) * 2
    sums, power, high = [0], [1], 0
    for c in text:
        sums.append((sums[-1] * _BASE + ord(c)) % _PRIME)
    for _ in range(size + 1):
        power.append(power[-1] * _BASE % _PRIME)

    def of(k: int, n: int) -> str:
        return f"{n}#{(sums[k + n] - sums[k] * power[n]) % _PRIME:x}#{text[k + n - 1]}"

    for k in range(size):
        yield of(k, size + 1), ""
        yield of(k + 1, size), word[k]
    yield of(size, size + 1), ""


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prefixes, skipped, counts = [], [], []
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            for prefix, c in rotations(word):
                prefixes.append(prefix)
                skipped.append(c)
            counts += [n] * (2 * len(word) + 1)
            if len(counts) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(skipped, pa.string()), pa.array(counts, pa.int64())], names=["prefix", "skipped", "n"])
                prefixes, skipped, counts = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(skipped, pa.string()), pa.array(counts, pa.int64())], names=["prefix", "skipped", "n"])


def _neighbours(prefix: str, run: list[tuple[str, int]], out: list[tuple[str, int, int | None, str | None]], ratio: int) -> None:
    """Of each word of one run: its neighbours there, and the most frequent if it may be the form.

    run: (skipped character, count), nothing skipped first. A character can be taken from or
    put into a row of equal ones at several places; only the first counts.
    """
    behind, _, before = prefix.partition(END)
    last = before[-1:]
    whole = run[0][1] if not run[0][0] else None
    ranked = sorted((-n, c) for c, n in run if c)
    for c, n in run:
        if c:
            near, best = len(ranked) - 1, None
            if near:
                best = ranked[1] if ranked[0][1] == c else ranked[0]
            if whole is not None and c != last:
                near += 1
                if best is None or (-whole, before + behind) < (best[0], before + best[1] + behind):
                    best = (-whole, "")
        else:
            inner = [x for x in ranked if x[1] != last]
            near, best = len(inner), inner[0] if inner else None
        if near:
            form = best is not None and -best[0] >= ratio * n
            out.append((before + c + behind, near, -best[0] if form else None, before + best[1] + behind if form else None))


def _scanned(ratio: int):
    """Over rows sorted by prefix and skipped character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the last run of the rows so far
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])]).combine_chunks()
            prefix = rows.column("prefix").combine_chunks()
            final = pc.index(prefix, prefix[-1]).as_py()
            kept = rows.slice(final)
            yield found(rows.slice(0, final))
        if kept is not None:
            yield found(kept)

    def found(rows: pa.Table) -> pa.RecordBatch:
        out: list[tuple[str, int, int | None, str | None]] = []
        if rows.num_rows > 1:
            prefix = rows.column("prefix").combine_chunks()
            same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1))
            no = pa.array([False])
            rows = rows.filter(pc.or_(pa.concat_arrays([no, same]), pa.concat_arrays([same, no])))
            last, group = None, []
            for p, c, n in zip(rows.column("prefix").to_pylist(), rows.column("skipped").to_pylist(), rows.column("n").to_pylist()):
                if p != last:
                    if group:
                        _neighbours(last, group, out, ratio)
                    last, group = p, []
                group.append((c, n))
            if group:
                _neighbours(last, group, out, ratio)
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "form_n", "form"]
        )

    return run


def _long_neighbours(words: DataFrame, ratio: int) -> DataFrame:
    """The same rows for words of more than LONG letters (and those one letter shorter, which may be near to them)."""
    some = words.where(F.char_length("word") >= LONG).withColumn("key", F.sha2("word", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, word, n in zip(*(b.column(c).to_pylist() for c in ("key", "word", "n"))):
                made = list(numbered_rotations(word))
                for k in range(0, len(made), 50_000):
                    part = made[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in part], pa.string()), pa.array([c for _, c in part], pa.string()), pa.array([key] * len(part), pa.string()), pa.array([n] * len(part), pa.int64()), pa.array([len(word)] * len(part), pa.int64())],
                        names=["prefix", "skipped", "key", "n", "letters"],
                    )

    turned = cut(some.select("key", "word", "n").mapInArrow(run, "prefix string, skipped string, key string, n long, letters long"))
    other = turned.select("prefix", F.col("skipped").alias("skipped2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("letters").alias("letters2"))
    first = F.substring_index("prefix", "#", -1)  # the letter before the skipped one
    pairs = turned.join(other, "prefix").where(
        (F.col("skipped") != F.col("skipped2"))
        & ((F.col("skipped") != "") | (first != F.col("skipped2"))) & ((F.col("skipped2") != "") | (first != F.col("skipped")))
        & (F.greatest("letters", "letters2") > LONG)
    )
    texts = some.select(F.col("key").alias("key2"), F.col("word").alias("form"))
    counted = pairs.groupBy("key", "key2").agg(F.first("n").alias("n"), F.first("n2").alias("n2"))
    formed = counted.join(texts, "key2").select(
        "key", F.lit(1).cast("long").alias("near"), *(F.when(F.col("n2") >= ratio * F.col("n"), F.col(c)).alias(a) for c, a in (("n2", "form_n"), ("form", "form")))
    )
    return formed.join(some.select("key", "word"), "key").select("word", "near", "form_n", "form")


def group_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), each once.

    A word's form is its near word of largest n (of several the first in code-point order), if
    that is at least `ratio` times the word's own; its root is where following forms ends.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, so that forms end")
    words = cut(words.select("word", "n"))
    turned = words.where(F.char_length("word") <= LONG).mapInArrow(_rotated, "prefix string, skipped string, n long")
    runs = turned.repartition("prefix").sortWithinPartitions("prefix", "skipped")
    near = runs.mapInArrow(_scanned(ratio), "word string, near long, form_n long, form string")
    if not words.where(F.char_length("word") > LONG).isEmpty():
        near = near.unionByName(_long_neighbours(words, ratio))
    best = near.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form")))).alias("best")
    )
    linked = cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")
        )
    )
    return linked.join(_roots(linked), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(linked: DataFrame) -> DataFrame:
    """word, root of all words with a form; each round doubles the steps, and n grows by the ratio at each, so rounds are few."""
    roots = cut(linked.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut(roots.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read_table(spark, sf_dir, "documents")))


#: CRC32 of a list of bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"

OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
), hashed AS (
  SELECT run, n, {_CRC.format(_BYTES.format("(d || ':' || run)"))} AS h
  FROM (SELECT d, run, count(*) AS n FROM runs GROUP BY ALL) WHERE length(run) >= 6
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), shorter AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1
), linked AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), steps AS (
  SELECT word, word AS root, form AS further FROM linked
  UNION ALL SELECT s.word, l.word, l.form FROM steps s JOIN linked l ON s.further = l.word
)
SELECT l.word, l.form, s.root, l.n, CAST(l.n_near AS BIGINT) AS n_near, l.form_n FROM linked l JOIN steps s ON s.word = l.word AND s.further IS NULL
"""
