"""Problem 2: the language of each document and of each segment of a mixed one.

Prediction by partial matching: for every language the byte contexts of the sample passages, up to ``ORDER`` bytes
long, keep symbol counts; a symbol unseen in a context costs an escape and is looked up in the next shorter context
(method C, symbols of the longer context excluded). The statistics are frozen after training, so the code length of any
byte after any context is a constant: all context trees are compiled into one automaton (state = longest known
context) with a table of bits per state, byte class and language, and a batch of sentences is scored by walking the
automaton for all sentences at once.

Defined results: null, empty and blank texts have no language; so have texts without letters and texts that no language
codes in under ``MOST_BITS`` a byte (program code, encoded data); where a row must stand for them, it is ``und`` with
confidence 0. A job answered from an earlier one has that one's language. Repeated rows count once.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.ranking import drawn
from docmill.session import cut_lineage, table

#: Three-letter forms (ISO 639-2, both variants) of two-letter codes. Fixed values.
CODES = {"eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "cat": "ca"}
NO_LANGUAGE = "und"  # the code of no language
UNKNOWN = ("", "und", "mul", "zxx", "mis", "unknown", "none", "null")
ORDER = 3
SAMPLES_A_LANGUAGE = 1_000  # bound of the labelled rows of each language that a model is fitted on, drawn by hash
TABLE_BYTES = 256 << 20  # bound of the broadcast bit table; beyond it the rarest long contexts are left out
MOST_BITS = 4.4  # bits a byte above which no language is named
SURE_BITS = 14.0  # lead in bits over the second language that a sentence needs to count
PIECE = 400  # bytes scored at once; a longer segment is cut into such pieces that carry its state on
MASK = 60  # languages in one mask of bits


def language_code(column: Column) -> Column:
    """Two-letter form of a code in any form (``en-US``, ``ENG``, ``pt_BR``); null where it names no language."""
    base = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]+)", 1)
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.when(column.isNull() | base.isin(*UNKNOWN), F.lit(None).cast("string")).otherwise(F.coalesce(known[base], base))


def fold(text: str) -> bytes:
    """Bytes that are scored: lower case, one space for white space, one digit for digits."""
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", text.lower())).encode("utf-8", "replace")


class Model:
    """Compiled context trees of all languages."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, _ in samples})
        texts = defaultdict(list)
        for lang, text in samples:
            texts[lang].append(b" " + fold(text) + b" ")
        seen = sorted({b for group in texts.values() for t in group for b in t})
        self.classes = np.zeros(256, np.int32)  # class 0: bytes no language has shown
        for i, b in enumerate(seen):
            self.classes[b] = i + 1
        size = self.size = len(seen) + 1
        counts: list[dict[tuple, dict[int, int]]] = []
        for lang in self.languages:
            own: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
            for text in texts[lang]:
                x = self.classes[np.frombuffer(text, np.uint8)].tolist()
                for i, symbol in enumerate(x):
                    for k in range(min(ORDER, i) + 1):
                        own[tuple(x[i - k : i])][symbol] += 1
            counts.append(own)
        states = sorted(self._contexts(counts), key=lambda c: (len(c), c))
        at = self.at = {c: i for i, c in enumerate(states)}
        bits = np.zeros((len(states), size, len(self.languages)), np.float32)
        for number, own in enumerate(counts):
            probability = np.zeros((len(states), size), np.float64)
            for i, context in enumerate(states):
                lower = probability[at[context[1:]]] if context else np.full(size, 1 / size)
                table_ = own.get(context)
                if not table_:
                    probability[i] = lower
                    continue
                symbols, n = np.fromiter(table_.keys(), int), np.fromiter(table_.values(), float)
                total = n.sum() + len(n)
                row = lower.copy()
                row[symbols] = 0
                rest = row.sum()
                row *= (len(n) / total) / rest if rest > 0 else 0
                row[symbols] = n / total
                probability[i] = row
            bits[:, :, number] = -np.log2(np.maximum(probability, 1e-9))
        if not states:  # no samples: no language is ever named
            self.bits, self.following = np.zeros((0, 0), np.float32), np.zeros(0, np.int32)
            return
        following = np.zeros((len(states), size), np.int32)
        for i, context in enumerate(states):
            for symbol in range(size):
                new = (*context, symbol)[-ORDER:]
                while new not in at:
                    new = new[1:]
                following[i, symbol] = at[new]
        self.bits = bits.reshape(-1, len(self.languages))
        self.following = following.reshape(-1)
        del self.at

    def _contexts(self, counts: list[dict[tuple, dict[int, int]]]) -> set[tuple]:
        """The contexts that are kept: all of them while their table fits in ``TABLE_BYTES``, else the longest ones only
        from a count on that is doubled until it fits. What a context starts or ends with is kept with it."""
        total: dict[tuple, int] = defaultdict(int)
        for own in counts:
            for context, symbols in own.items():
                total[context] += sum(symbols.values())
        most = TABLE_BYTES // (4 * self.size * max(len(counts), 1))
        for order in range(ORDER, 0, -1):
            least = 2
            while len(total) > most and any(len(c) == order for c in total):
                total = defaultdict(int, {c: n for c, n in total.items() if len(c) < order or n >= least})
                least *= 2
        return set(total)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts or not self.languages:
            return out
        owner, pieces, starts = [], [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), PIECE):
                owner.append(i)
                starts.append(a)
                pieces.append(t[a : a + PIECE])
        if not pieces:
            return out
        length = np.array([len(p) for p in pieces])
        order = np.argsort(-length, kind="stable")
        data = self.classes[np.frombuffer(b"".join(pieces), np.uint8)]
        begin = (np.cumsum(length) - length)[order]
        length = length[order]
        # the state is the longest known context of the last ORDER bytes: a later piece takes it from those before it
        whole = np.array([texts[i][max(0, a - ORDER) : a] == b"" for i, a in zip(owner, starts)])[order]
        state = np.where(whole, self.following[self.classes[32]], 0).astype(np.int32)
        for k in range(ORDER, 0, -1):
            later = np.flatnonzero(~whole)
            state[later] = self.following[state[later] * self.size + data[begin[later] - k]]
        cost = np.zeros((len(pieces), len(self.languages)), np.float32)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t in range(int(length[0])):
            k = active[t]
            arc = state[:k] * self.size + data[begin[:k] + t]
            cost[:k] += self.bits[arc]
            state[:k] = self.following[arc]
        np.add.at(out, np.array(owner)[order], cost)
        return out


def train(samples: DataFrame) -> bytes:
    """A pickled :class:`Model` from passages (lang, text) of certain language, at most ``SAMPLES_A_LANGUAGE`` of each."""
    known = samples.filter("lang is not null and text is not null").select(language_code(F.col("lang")).alias("lang"), "text").filter("lang is not null")
    rows = drawn(known, "lang", "text", SAMPLES_A_LANGUAGE).select("lang", "text").orderBy("lang", "text").collect()
    return pickle.dumps(Model([(r["lang"], r["text"]) for r in rows]))


_OPEN: dict[int, Model] = {}


def opened(blob: bytes) -> Model:
    key = hash(blob)
    if key not in _OPEN:
        _OPEN[key] = pickle.loads(blob)
    return _OPEN[key]


JOIN = re.compile(r"(?<=[^\W\d_])[-­‐‑¬][ \t]*\n[ \t]*(?=[^\W\d_])")
SPLIT = re.compile(r"\n[ \t]*\n\s*|\n(?=[ \t]*[-*•|#>])|(?<=[.!?…])[\"”»’)]*\s+")
WORD = re.compile(r"[^\W\d_]{2,}")


def prepared(text: str) -> tuple[str, Callable[[int], int]]:
    """The text to split, and the way back from a position in it to one in ``text``.

    Lines wrapped in the middle of a sentence are joined; a table row stands for itself.
    """
    cuts, joined = [(0, 0)], text
    for m in JOIN.finditer(text):
        cuts.append((m.start() - cuts[-1][1], cuts[-1][1] + len(m[0])))
    if len(cuts) > 1:
        joined = JOIN.sub("", text)
    added, now = [(0, 0)], joined
    if "\t" in joined or "|" in joined:
        lines, at = joined.split("\n"), 0
        for i, x in enumerate(lines):
            if "\t" in x or "|" in x:
                before = added[-1][1]
                added += [(at + 1, before - 1), (at + len(x) + 2, before - 2)]
                lines[i] = f"\n{x}\n"
            at += len(lines[i]) + 1
        now = "\n".join(lines)

    def back(p: int) -> int:
        for shifts in (added, cuts):
            if len(shifts) > 1:
                p += shifts[bisect_right(shifts, (p, 1 << 60)) - 1][1]
        return p

    return now, back


def segments(text: str) -> list[str]:
    """Sentences, list items and table rows of a text, in order; lines wrapped in the middle of a sentence are joined."""
    return [s for s in SPLIT.split(prepared(text)[0]) if s and not s.isspace()]


def places(text: str) -> list[tuple[int, int]]:
    """Where the segments of a text stand in it, without white space around them."""
    now, back = prepared(text)
    out, at = [], 0
    for end, following in [*(m.span() for m in SPLIT.finditer(now)), (len(now), len(now))]:
        s = now[at:end]
        if s and not s.isspace():
            out.append((back(at + len(s) - len(s.lstrip())), back(at + len(s.rstrip()) - 1) + 1))
        at = following
    return out


def is_sentence(segment: str) -> bool:
    return "\t" not in segment and "|" not in segment and len(WORD.findall(segment)) >= 4


def scored_segments(model: Model, pages: list[str | None]) -> tuple[list[str], list[int], list[bytes], np.ndarray]:
    """The segments of all pages, their pages, what is scored of them and their code lengths."""
    texts, owner = [], []
    for i, page in enumerate(pages):
        if page and not page.isspace():
            for s in segments(page):
                texts.append(s)
                owner.append(i)
    folded = [fold(t) for t in texts]
    return texts, owner, folded, model.score(folded)


def trust_of(bits: np.ndarray) -> np.ndarray:
    """Confidence in the language of the least code length, a row each."""
    return 1 / (1 + np.exp2(np.minimum(-(bits - bits.min(1)[:, None]) / 8, 0)).sum(1) - 1)


def decide(model: Model, pages: list[str | None], scored: tuple | None = None) -> tuple[np.ndarray, list[list[list]]]:
    """For each page the bytes in each language, and its runs of whole sentences.

    A run is (segment text, language, confidence, sentences, first and last segment of the batch).
    """
    texts, owner, folded, bits = scored_segments(model, pages) if scored is None else scored
    weights = np.zeros((len(pages), len(model.languages)))
    runs: list[list[list]] = [[] for _ in pages]
    if not texts or not model.languages:
        return weights, runs
    best = bits.argmin(1)
    low = bits.min(1)
    second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else low + 99
    length = np.array([max(len(t), 1) for t in folded])
    trust = trust_of(bits)
    for at, (i, text, b, lead, per_byte, n, c) in enumerate(zip(owner, texts, best, second - low, low / length, length, trust)):
        if per_byte > MOST_BITS or lead < 4:
            continue
        weights[i, b] += n
        if lead < SURE_BITS or not is_sentence(text):
            continue
        lang, own = model.languages[b], runs[i]
        if own and own[-1][1] == lang:
            own[-1][0] += " " + text
            own[-1][2] = min(own[-1][2], float(c))
            own[-1][3] += 1
            own[-1][5] = at
        else:
            own.append([text, lang, float(c), 1, at, at])
    return weights, runs


def stretches(model: Model, pages: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """For each page the stretches (char_start, char_end, language, confidence) that all its segments belong to, in order.

    Sure sentences make the stretches. What stands between two of them, too short to be sure of, is divided where both
    languages together code it in the fewest bits. A page without a sure sentence is one stretch.
    """
    scored = _, owner, folded, bits = scored_segments(model, pages)
    weights, runs = decide(model, pages, scored)
    number = {lang: i for i, lang in enumerate(model.languages)}
    first = np.searchsorted(owner, np.arange(len(pages) + 1))
    out: list[list[tuple[int, int, str, float]]] = []
    for i, page in enumerate(pages):
        lo, hi, own = first[i], first[i + 1], runs[i]
        if lo == hi:
            out.append([])
            continue
        if own:
            cuts = [lo]
            for (_, a, _, _, _, end), (_, b, _, _, start, _) in zip(own, own[1:]):
                between = bits[end + 1 : start]
                left, right = np.cumsum(between[:, number[a]]), np.cumsum(between[::-1, number[b]])[::-1]
                cuts.append(end + 1 + int((np.append(0, left) + np.append(right, 0)).argmin()))
            named = [(r[1], round(r[2], 4)) for r in own]
        else:
            cuts, named = [lo], [(NO_LANGUAGE, 0.0)]
            if weights[i].any():  # as much as its segments say together
                whole = bits[lo:hi].sum(0, keepdims=True)
                named = [(model.languages[int(whole.argmin())], round(float(trust_of(whole)[0]), 4))]
        at = places(page)
        out.append([(at[a - lo][0], at[b - 1 - lo][1], *name) for a, b, name in zip(cuts, [*cuts[1:], hi], named)])
    return out


def page_languages(pages: DataFrame, samples: DataFrame) -> tuple[DataFrame, list[str]]:
    """Per page, once: page_key, job_id, bytes in each language (w0, w1, ...) and, as bits of m0, m1, ..., the languages
    with at least two consecutive sentences.

    One scan; the model is broadcast (bounded by ``TABLE_BYTES``). What is shuffled to tell repeated rows are numbers.
    """
    blob = train(samples)
    languages = opened(blob).languages
    sent = pages.sparkSession.sparkContext.broadcast(blob)
    masks = max(1, -(-len(languages) // MASK))
    names = [*(f"w{i}" for i in range(len(languages))), *(f"m{i}" for i in range(masks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        number = {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                weights, runs = decide(model, part.column(2).to_pylist())
                bits = np.zeros((part.num_rows, masks), np.int64)
                for i, own in enumerate(runs):
                    for r in own:
                        if r[3] >= 2:
                            bits[i, number[r[1]] // MASK] |= 1 << number[r[1]] % MASK
                columns = [*weights.astype(np.int64).T, *bits.T]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in columns)], names=["page_key", "job_id", *names])

    scored = pages.select("page_key", "job_id", "text").mapInArrow(run, "page_key long, job_id string, " + ", ".join(f"{n} long" for n in names))
    return scored.groupBy("page_key", "job_id").agg(*[F.max(n).alias(n) for n in names]), languages


def job_languages(scored: DataFrame, languages: list[str]) -> DataFrame:
    """(job_id, lang, confidence): the language most of a job's text is in and its share of the text."""
    if not languages:
        return scored.select("job_id", F.lit("").alias("lang"), F.lit(0.0).alias("confidence")).limit(0)
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(languages))]
    per_job = scored.filter("job_id is not null").groupBy("job_id").agg(*sums)
    best = F.greatest(F.struct(F.lit(-1).cast("long").alias("w"), F.lit("").alias("lang")), *[F.struct(F.col(f"w{i}").alias("w"), F.lit(lang).alias("lang")) for i, lang in enumerate(languages)])
    total = sum(F.col(f"w{i}") for i in range(len(languages)))
    return per_job.select("job_id", best.alias("best"), total.alias("total")).filter("best.w > 0").select("job_id", F.col("best.lang").alias("lang"), F.round(F.col("best.w") / F.col("total"), 4).alias("confidence"))


def mixed_pages(scored: DataFrame, languages: list[str]) -> DataFrame:
    """(page_key, lang) of pages with at least two consecutive sentences in each of two or more languages."""
    held = F.array(*[F.when(F.col(f"m{i // MASK}").bitwiseAND(F.lit(1 << i % MASK)) != 0, F.lit(lang)) for i, lang in enumerate(languages)])
    named = scored.select("page_key", (F.filter(held, lambda x: x.isNotNull()) if languages else F.array().cast("array<string>")).alias("langs"))
    return named.filter(F.size("langs") >= 2).select("page_key", F.explode("langs").alias("lang"))


def scored_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    once, languages = page_languages(table(spark, sf, "page_results"), table(spark, sf, "lang_samples"))
    return cut_lineage(once), languages


def every_job_language(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """(job_id, lang, confidence) of every job: its own of ``found``, else that of the job it was answered from, else none."""
    from docmill.llm.tokens import current_rows

    now = current_rows(jobs, "cached_from_job_id").select(F.col("id").alias("now_id"), "cached_from_job_id")
    own = now.join(found, now["now_id"] == found["job_id"], "full").select(F.coalesce("now_id", "job_id").alias("job_id"), "lang", "confidence", "cached_from_job_id")
    earlier = found.select(F.col("job_id").alias("earlier_id"), F.col("lang").alias("earlier_lang"), F.col("confidence").alias("earlier_confidence"))
    both = own.join(earlier, own["lang"].isNull() & (own["cached_from_job_id"] == earlier["earlier_id"]), "left")
    return both.select("job_id", F.coalesce("lang", "earlier_lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("confidence", "earlier_confidence", F.lit(0.0)).alias("confidence"))


def page_stretches(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(page_key, char_start, char_end, lang, confidence): the stretches of every page, with offsets in its text."""
    sent = pages.sparkSession.sparkContext.broadcast(train(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[dict(zip(names, s)) for s in own] for own in stretches(model, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["page_key", "stretches"])

    scored = pages.select("page_key", "text").mapInArrow(run, "page_key long, stretches array<struct<char_start int, char_end int, lang string, confidence double>>")
    once = scored.groupBy("page_key").agg(F.max("stretches").alias("stretches"))
    return once.select("page_key", F.inline("stretches"))


def wrong_labels(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Jobs of ``found`` (job_id, lang) whose current label is missing or names another language: (id, lang)."""
    from docmill.llm.tokens import current_rows

    now = current_rows(jobs, F.col("language.code").alias("code"))
    both = found.join(now, found["job_id"] == now["id"])
    return both.filter(~F.coalesce(language_code(F.col("code")) == F.col("lang"), F.lit(False))).select("id", "lang")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    scored, languages = scored_pages(spark, sf)
    jobs = wrong_labels(table(spark, sf, "jobs"), job_languages(scored, languages)).select(F.lit("job").alias("src"), F.col("id").alias("rec_id"), "lang")
    pages = mixed_pages(scored, languages).select(F.lit("page").alias("src"), F.col("page_key").cast("string").alias("rec_id"), "lang")
    return jobs.unionByName(pages).distinct()


def p2_job_languages(spark: SparkSession, sf: str) -> DataFrame:
    scored, languages = scored_pages(spark, sf)
    return every_job_language(table(spark, sf, "jobs"), job_languages(scored, languages))


def p2_segments(spark: SparkSession, sf: str) -> DataFrame:
    return page_stretches(table(spark, sf, "page_results"), table(spark, sf, "lang_samples"))
