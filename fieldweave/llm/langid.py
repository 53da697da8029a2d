"""Language identification: words first, then ever shorter character n-grams for words that are not known."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from fieldweave.llm.common import Workspace, bounded, crc32_of, lean, map_rows, need

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
HELD = 20_000  # keys that a task counts before it sends them on


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class WordModel:
    """Log frequencies by language of the commonest words and n-grams.

    orders[0] gives the row in `logs` of words, orders[n] that of n-grams. Scores of up to `cache` words are kept for the next text.
    """

    cache = 50_000

    def __init__(self, langs: list[str], orders: list[dict[str, int]], logs: np.ndarray):
        self.langs, self.orders, self.logs = langs, orders, logs
        self.reset()

    def __getstate__(self):
        return self.langs, self.orders, self.logs

    def __setstate__(self, state):
        self.__init__(*state)

    def reset(self):
        self.row: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, len(self.langs)))

    @classmethod
    def from_counts(cls, langs: list[str], counts):
        """counts: (order, lang, gram, n) of what is kept, with n over the whole sample."""
        at = {x: i for i, x in enumerate(langs)}
        orders: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        cells, size = [], 0
        for order, lang, gram, n in counts:
            row = orders[order].setdefault(gram, size)
            size += row == size
            cells.append((row, at[lang], n))
        logs = np.zeros((size, len(langs)))
        for row, lang, n in cells:
            logs[row, lang] += n
        for table in orders:
            rows = np.fromiter(table.values(), np.int64, len(table))
            logs[rows] = np.log((logs[rows] + 0.5) / (logs[rows].sum(axis=0) + 0.5 * len(table) + 1))
        return cls(langs, orders, logs)

    def known(self, word: str) -> list[int]:
        """Rows of `logs` that stand for a word: its own if it is known, else those of its known n-grams of the longest order that has any."""
        if (row := self.orders[0].get(word)) is not None:
            return [row]
        for n in range(LONGEST, 0, -1):
            get = self.orders[n].get
            found = [r for g in grams_of(word, n) if (r := get(g)) is not None]
            if found:
                return found
        return []

    def score(self, word: str) -> np.ndarray:
        """Log frequency by language: the mean over the rows that stand for the word."""
        found = self.known(word)
        return self.logs[found].mean(axis=0) if found else np.zeros(len(self.langs))

    def rows(self, words: list[str]) -> list[int]:
        """Rows of `table` with the words' scores. Row 0 is zero: of what has no letter."""
        get, out, new = self.row.get, [], []
        first = len(self.row)
        for w in words:
            r = get(w)
            if r is None:
                if w[0].isalpha() or any(map(str.isalpha, w)):
                    r = self.row[w] = len(self.row)
                    new.append(self.known(w))
                else:
                    r = 0
            out.append(r)
        if new:
            while len(self.table) < len(self.row):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            size = np.array([len(x) for x in new])
            where = np.repeat(np.arange(first, first + len(new)), size)
            scores = self.logs[[r for x in new for r in x]] / np.repeat(size, size)[:, None]
            self.table[first : first + len(new)] = 0
            np.add.at(self.table, where, scores)
        return out

    def predict(self, text: str | None, evidence: int = 30) -> tuple[str, float]:
        """The likeliest language and its share. Scores of long texts are scaled down to those of `evidence` words."""
        z, n = np.zeros(len(self.langs)), 0
        for part in parts_of(text or ""):
            if len(self.row) > self.cache:
                self.reset()
            seen = Counter(words_of(part))
            rows, times = np.array(self.rows(list(seen)), np.int64), np.fromiter(seen.values(), np.int64, len(seen))
            z += times @ self.table[rows] if len(rows) else 0
            n += int(times[rows > 0].sum())
        if not n or not self.langs:
            return "und", 0.0
        z *= min(1.0, evidence / n)
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.langs[best], float(p[best] / p.sum())


def parts_of(text: str, size: int = 1 << 18):
    """The text in parts that end outside words, so that a huge one isn't held as words at once."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield text[at:end]
        at = end


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 5_000, words: int = 120_000, grams: int = 30_000) -> WordModel:
    """Learn from texts and non-null languages of rows whose crc32(id) mod 5 is not 0.

    At most about `per_lang` rows of each language are used, chosen by a hash of the id. Words are counted where the texts lie and
    summed by word; n-grams come from the sums, each distinct word once. The model keeps the commonest, `words` and `grams` of each order
    in all, ties in the order of code points, so its size is bounded whatever the input. Without such rows nothing is learned.
    """
    src = need(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    src = src.where((crc32_of("id") % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return WordModel([], [{} for _ in range(LONGEST + 1)], np.zeros((0, 0)))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    chosen = src.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    work = Workspace(docs.sparkSession, "language")

    @lean
    def count_words(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for part in parts_of(text.as_py()):
                    seen.setdefault(lang, Counter()).update(words_of(part))
                    if sum(map(len, seen.values())) > HELD:
                        yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for lang, counter in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["lang", "gram", "n"])
        seen.clear()

    @lean
    def count_grams(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                counter = seen.setdefault(lang, Counter())
                for k in range(1, LONGEST + 1):
                    for g in grams_of(word, k):
                        counter[f"{k}{g}"] += n
                if sum(map(len, seen.values())) > HELD:
                    yield from flush(seen)
        yield from flush(seen)

    kind = "lang string, gram string, n bigint"
    counted = work.save(chosen.select("text", "lang").mapInArrow(count_words, kind).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    by_order = counted.mapInArrow(count_grams, kind).groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(F.substring("gram", 1, 1).cast("int").alias("k"), "lang", F.expr("substring(gram, 2)").alias("gram"), "n")

    def commonest(table: DataFrame, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("k", "lang").orderBy(F.desc("n"), "gram"))
        return table.withColumn("place", place).where(F.col("place") <= most // len(langs)).select("k", "lang", "gram", "n")

    kept = commonest(counted.withColumn("k", F.lit(0)), words).unionByName(commonest(by_order, grams))
    t = kept.toArrow()
    work.drop(counted)
    return WordModel.from_counts(langs, zip(*(t.column(c).to_pylist() for c in ("k", "lang", "gram", "n")), strict=True))


def identify(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, held_out, lang_pred, score.

    `lang_pred` is `und`, with score 0, if the text is null, empty or has no letter, or if nothing was learned. Equal scores go to the
    language first in alphabetical order. Null ids count as learned from (held_out false). Repeated rows stay. Very long texts are
    read whole, in parts. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = need(docs, id_col, text_col).withColumn("held_out", F.coalesce(crc32_of(id_col) % 5 == 0, F.lit(False)))

    @lean
    def run(batches):
        for b in batches:
            found = [shared.value.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["_0", "_1", "_2", "_3"])

    kinds = [src.schema[id_col], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return map_rows(src, run, StructType(kinds))


def keep_identified(docs: DataFrame, model: WordModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose language is identified with a score of at least `least`.

    Rows whose text is null, empty or without letters go. Where nothing was learned, every row with letters stays.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        for b in batches:
            keep = []
            for x in b.column(at):
                text = x.as_py()
                lang, score = shared.value.predict(text)
                keep.append(score >= least if shared.value.langs else any(map(str.isalpha, text or "")))
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run)
