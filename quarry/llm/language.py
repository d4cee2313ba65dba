"""Language identification by cross-parsing: how few phrases of a language's sample a text falls into."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, held, slices, table, texts, trimming, written

#: The bound of the fit: documents of each language, characters of each of these, of a language, and in all; where languages
#: are so many that they have to share the latter, fewest documents of each.
SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS, ALL_CHARS, FEWEST_DOCS = 400, 160, 50_000, 1_000_000, 16
#: Most entries of all automata's tables together (64 MB); where those of a language would take more than its share, its arcs are searched.
ALL_CELLS = 1 << 24
#: Texts are parsed in blocks of so many characters; a phrase ends with its block.
BLOCK = 256
FOLDS, HELD_OUT, UNDETERMINED = 4, 2, "und"
#: Bound on the phrases a character of a text in a language: of all labelled documents that weren't learned, so high a
#: quantile, times WIDE plus SHORT a root of the text's characters. With fewer than LEAST_DOCS of them it is STRANGE.
QUANTILE, WIDE, SHORT, LEAST_DOCS, STRANGE = 0.99, 1.75, 6.0, 100, 0.7


def held_out(doc_id: str) -> Column:
    """Whether the id's fold is held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def labelled(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(lang, text, id) of the documents with a label and a letter."""
    return docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("id")
    )


def place(seed: int) -> Column:
    """A number from 0 to 1 by a hash of id and text."""
    return F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> dict[str, str]:
    """Text of each language from labelled documents with a letter, about SAMPLE_DOCS of them chosen by a hash of id and text.

    The hash's threshold follows from the language's count over all documents. Of each document an excerpt is taken, at a
    place that the hash chooses; equal excerpts of a language count once, and a bound holds for each language by itself, so no
    repeated row crowds out others. All languages are learned, from the less the more there are.
    """
    known = labelled(docs, doc_id, text, lang)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    most = max(min(SAMPLE_CHARS, ALL_CHARS // len(counts)), DOC_CHARS)
    each = min(SAMPLE_DOCS, max(2 * most // DOC_CHARS, FEWEST_DOCS))
    share = F.map_from_entries(F.array(*(F.struct(F.lit(r["lang"]), F.lit(min(1.0, each / r["n"]))) for r in counts)))
    taken = known.where(place(7) < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    start = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.greatest(F.length("text") - DOC_CHARS + 1, F.lit(1))).cast("int") + 1
    excerpt = F.substring("text", start, F.lit(DOC_CHARS))
    some = taken.groupBy("lang", excerpt.alias("text")).agg(F.min(F.xxhash64("id")).alias("at"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    rows = some.withColumn("n", first).where(F.col("n") <= 4 * each).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[:most]
    return out


class Classes:
    """Characters as small numbers: 0 for all but letters, a number for each letter of the samples in either case, last for other letters."""

    def __init__(self, samples: list[str]):
        letters = sorted({c for s in samples for c in s.lower() if c.isalpha()})
        self.width = len(letters) + 2
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.of = np.fromiter(
            (0 if not c.isalpha() else number.get(c.lower(), self.width - 1) for c in map(chr, range(0x110000))), np.int32, 0x110000
        )

    def read(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts one after another, each text's length); a text starts and ends with one 0, and no 0 follows a 0."""
        codes = np.frombuffer("".join([f" {x} " for x in found]).encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.cumsum([0, *(len(x) + 2 for x in found)])
        numbers = self.of[codes]
        keep = numbers != 0
        keep[1:] |= numbers[:-1] != 0
        keep[bounds[:-1]] = True
        return numbers[keep], np.add.reduceat(keep, bounds[:-1], dtype=np.int64)


class SuffixAutomaton:
    """All substrings of a sequence of numbers, as a table with a row for each state, or as sorted arcs where that is too large."""

    def __init__(self, sequence: list[int], width: int, most: int = ALL_CELLS):
        # Online construction: state 0 is the empty phrase, link the longest proper suffix of another class.
        steps: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[q] != length[p] + 1:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = copy
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    q = copy
                link[new] = q
            last = new
        self.width, self.table = width, None
        if (len(steps) + 2) * width > most:
            arcs = sorted((state * width + c, t) for state, x in enumerate(steps) for c, t in x.items())
            self.keys, self.targets = np.array([k for k, _ in arcs], np.int64), np.array([t for _, t in arcs], np.int32)
            self.root = np.full(width, -1, np.int32)  # a letter that the sample lacks is a phrase by itself
            self.root[list(steps[0])] = list(steps[0].values())
            return
        # An entry is the row's start of the next state; where the phrase can't go on, minus that of the phrase which begins
        # anew. Row 0 stays unused, so that no row's start is its own negative; at the last row no phrase is open.
        table = np.zeros((len(steps) + 2, width), np.int32)
        for state, x in enumerate(steps):
            if x:
                table[state + 1, list(x)] = [(t + 1) * width for t in x.values()]
        self.none_open = (len(steps) + 1) * width
        root = np.where(table[1] > 0, table[1], self.none_open)
        self.table = np.where(table > 0, table, -root).ravel()

    def phrases(self, blocks: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Phrases of each block. blocks: a row for each place, a column for each block, the longest first; on: blocks with that place."""
        found = np.zeros(blocks.shape[1], np.int32)
        if self.table is None:
            state = np.full(blocks.shape[1], -1, np.int64)
            for row, n in zip(blocks, on.tolist(), strict=True):
                key = state[:n] * self.width + row[:n]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                goes = self.keys[at] == key
                found[:n] += ~goes
                state[:n] = np.where(goes, self.targets[at], self.root[row[:n]])
            return found
        state = np.full(blocks.shape[1], self.none_open, np.int32)
        for row, n in zip(blocks, on.tolist(), strict=True):
            next_ = self.table[state[:n] + row[:n]]
            found[:n] -= next_ >> 31
            np.abs(next_, out=state[:n])
        return found


class Model:
    def __init__(self, samples: dict[str, str], cells: int = ALL_CELLS):
        self.names = sorted(samples)
        self.classes = Classes(list(samples.values()))
        self.automata = [SuffixAutomaton(self.classes.read([samples[x]])[0].tolist(), self.classes.width, cells // len(self.names)) for x in self.names]

    def phrase_rates(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases a character for each text and language, whether each text has a letter)."""
        numbers, lengths = self.classes.read(found)
        bounds = np.cumsum(lengths) - lengths
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(found)), blocks)
        start = bounds[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(BLOCK, bounds[owner] + lengths[owner] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        places = np.arange(size[0])
        matrix = numbers[np.minimum(start[None, :] + places[:, None], len(numbers) - 1)]
        on = np.searchsorted(-size, -places, side="left")
        counts = [np.bincount(owner, a.phrases(matrix, on), len(found)) for a in self.automata]
        lettered = np.add.reduceat(numbers > 0, bounds, dtype=np.int64) > 0
        return np.stack(counts, 1) / lengths[:, None], lettered

    def predict(self, found: list[str]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, phrases a character) of each text; score is by how much the second language needs more phrases."""
        rates, lettered = self.phrase_rates(found)
        best = rates.argmin(1)
        ranked = np.sort(rates, 1)
        score = 1 - ranked[:, 0] / ranked[:, 1] if len(self.names) > 1 else np.ones(len(found))
        names = [self.names[i] if x else UNDETERMINED for i, x in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, score, 0.0).tolist(), np.where(lettered, ranked[:, 0], 1.0).tolist()


def identify(docs: DataFrame, text: str, samples: dict[str, str], keep: tuple[str, ...], names: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """keep's columns, then by these names the language, its score and its phrases a character, of each document.

    A text that is null or has no letter is UNDETERMINED with score 0 and rate 1, and so are all where nothing was learned.
    Ties go to the first language by name; repeated rows are judged each for itself; an empty table gives no rows. keep must
    not hold the names.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(samples), uuid.uuid4().hex
    own = fresh(keep, "__text")
    wanted = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).cast("string").alias(own))
    out = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")
    at = wanted.columns.index(text if text in keep else own)

    def judged(batches):
        model = held(("language", key), lambda: Model(shared.value)) if shared.value else None
        for batch in slices(batches, most=1 << 20):  # a parse takes many times its text
            found = texts(batch.column(at))
            answers = model.predict(found) if model else ([UNDETERMINED] * len(found), [0.0] * len(found), [1.0] * len(found))
            columns = [pa.array(a, k) for a, k in zip(answers, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=out.fieldNames())

    return wanted.mapInArrow(trimming(judged, "language"), out)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; see identify for nulls and texts without letters."""
    docs = table(spark, sf_dir, "documents")
    samples = sample(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    found = identify(docs, "text", samples, ("doc_id",))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def bounds(found: DataFrame, doc_id: str, text: str, lang: str, predicted: str, rate: str) -> dict[str, float]:
    """The QUANTILE of phrases a character of each language, where LEAST_DOCS labelled documents tell it, from identify's rows.

    All labelled documents whose language was found count, but those that sample may have learned from.
    """
    known = found.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("id"), F.col(predicted).alias("predicted"), F.col(rate).alias("rate"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect() if r["n"] > SAMPLE_DOCS}
    if not counts:
        return {}
    learned = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, SAMPLE_DOCS / n)))[F.col("lang")]
    rated = known.where((place(7) >= learned) & (F.col("lang") == F.col("predicted")))
    rows = rated.groupBy("lang").agg(F.percentile_approx("rate", QUANTILE).alias("rate"), F.count("*").alias("n")).collect()
    return {r["lang"]: r["rate"] for r in rows if r["n"] >= LEAST_DOCS}


def recognised(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """docs whose text is in a language that their labels teach; a null label becomes the language found.

    Texts without a letter go, and texts unlike all languages: of more phrases a character than the labelled documents of
    the language found have, with a margin that is the wider the shorter a text is. With no label at all, nothing can be
    judged but the former.
    """
    samples = sample(docs, doc_id, text, lang)
    if not samples:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    names = tuple(fresh(docs.columns, x) for x in ("__lang", "__score", "__rate"))
    found = written(identify(docs, text, samples, tuple(docs.columns), names), "languages")
    usual = bounds(found, doc_id, text, lang, names[0], names[2])
    most = F.lit(STRANGE)
    if usual:
        of = F.create_map(*(F.lit(x) for kv in usual.items() for x in kv))[F.col(names[0])]
        most = F.coalesce(F.least(most, of * (WIDE + SHORT / F.sqrt(F.length(F.col(text).cast("string"))))), most)
    good = found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) <= most))
    return good.withColumn(lang, F.coalesce(F.col(lang).cast("string"), names[0])).select(*docs.columns)
