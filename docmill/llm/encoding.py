"""Problem 4: text decoded with a wrong character encoding.

Words of the corpus are grouped by what is left of them without non-ASCII characters. Inside such a group the shortest
spelling is the clean near-twin; the ASCII characters of a longer spelling align one to one with the twin's, so each run
of non-ASCII characters between them pairs with the run it stands for. Pairs seen in several words are votes for
transformations ("UTF-8 read as ..."); accepted transformations, extended to all characters they can garble, and the
pairs no transformation explains form the mapping that is then applied to every record. A word with replacement
characters (U+FFFD) is restored where exactly one clean word of the corpus is the same in all other characters.

Defined results: null, empty and blank texts are not affected; replacement characters without such a word and C1 controls
mark a text as affected but not recoverable; numeric character references count only where they spell a garbled sequence.
Repeated rows are one page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.ranking import collected
from docmill.session import cut_lineage, table

#: Encodings that UTF-8 bytes are commonly read in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "iso8859_15")
LEAST_PAIRS = 3  # distinct aligned pairs, from distinct words, that accept a transformation
LEAST_WORDS = 3  # distinct words that accept a pair no transformation explains
MOST_RUNS = 200_000  # such pairs that the mapping may hold; more are an error, none is dropped silently
REFERENCE = re.compile(r"&#(\d{2,6});")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[^ \n\t\r]+")
BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")


def referred(m: re.Match) -> str:
    """The character of a numeric reference, where it is above ASCII."""
    return chr(int(m[1])) if 127 < int(m[1]) < 0x110000 and not 0xD800 <= int(m[1]) < 0xE000 else m[0]


def references(text: str) -> str:
    """Numeric references of characters above ASCII resolved."""
    return REFERENCE.sub(referred, text) if "&#" in text else text


class Trace:
    """A text that substitutions rewrite, and the way back from a span of it to the span of the original."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.passes: list[list[tuple[int, int, int, int]]] = []  # start and end of each change, after it and before it

    def sub(self, pattern: re.Pattern, put: Callable[[re.Match], str]) -> bool:
        out, at, size, held = [], 0, 0, []
        for m in pattern.finditer(self.text):
            new = put(m)
            out += [self.text[at : m.start()], new]
            size += m.start() - at
            held.append((size, size + len(new), m.start(), m.end()))
            size += len(new)
            at = m.end()
        if held:
            self.text = "".join([*out, self.text[at:]])
            self.passes.append(held)
        return bool(held)

    def back(self, a: int, b: int) -> tuple[int, int]:
        for held in reversed(self.passes):
            i, j = bisect_right(held, (a, 1 << 60)) - 1, bisect_left(held, (b,)) - 1
            if i >= 0:
                a = held[i][2] if a < held[i][1] else a + held[i][3] - held[i][1]
            if j >= 0:
                b = held[j][3] if b <= held[j][1] else b + held[j][3] - held[j][1]
        return a, b


def read_wrong(text: str, encoding: str) -> str:
    """UTF-8 bytes of ``text`` read in ``encoding``; bytes it leaves undefined become the control of that number."""
    out = []
    for byte in text.encode("utf-8"):
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of distinct words with non-ASCII characters, pre-aggregated in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not (text.isascii() and "&#" not in text):
                    seen.update(w for w in references(text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if not w.isascii())
            if len(seen) > 300_000:
                yield out()
        yield out()

    return pages.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def aligned_pairs(words: DataFrame) -> DataFrame:
    """(garbled, clean, words): runs that near-twins show for each other, with the number of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(0).to_pylist()
            rest = [NON_ASCII.sub("", w) for w in spelled]
            keep = [sum(c.isalpha() for c in r) >= 3 for r in rest]
            rows = [(r, w, n, len(w) - len(r), "�" in w) for r, w, n, k in zip(rest, spelled, batch.column(1).to_pylist(), keep) if k]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rest", "word", "n", "extra", "broken"])

    keyed = words.mapInArrow(run, "rest string, word string, n long, extra int, broken boolean").filter("not broken")
    twin = keyed.groupBy("rest").agg(F.min(F.struct("extra", (-F.col("n")).alias("m"), "word")).alias("twin"))
    both = keyed.join(twin, "rest").filter(F.col("extra") > F.col("twin.extra")).select("rest", "word", F.col("twin.word").alias("clean"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for word, clean in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for g, c in zip(runs(word), runs(clean)):
                    if g != c and len(g) > len(c) and c:
                        out.add((g, c, clean))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["garbled", "clean", "word"])

    votes = both.mapInArrow(align, "garbled string, clean string, word string")
    return votes.distinct().groupBy("garbled", "clean").agg(F.count("*").alias("words"))


def runs(word: str) -> list[str]:
    """The non-ASCII run before each ASCII character and at the end (most are empty)."""
    out, held = [], []
    for c in word:
        if ord(c) < 128:
            out.append("".join(held))
            held = []
        else:
            held.append(c)
    return [*out, "".join(held)]


def explaining(garbled: str, clean: str) -> list[str]:
    """The encodings in which the bytes of ``clean``, read once or twice, give ``garbled``."""
    out = []
    for encoding in READ_AS:
        once = read_wrong(clean, encoding)
        if garbled == once or garbled == read_wrong(once, encoding):
            out.append(encoding)
    return out


def settle(votes: dict[str, int], alphabet: set[str], others: list[tuple[str, str, int, int]]) -> dict[str, str]:
    """The mapping garbled -> clean from the votes of each encoding, the characters that explained pairs stand for, and
    the best reading of each run that no encoding explains, as (garbled, clean, words, words of all its readings)."""
    accepted = [e for e in READ_AS if votes.get(e, 0) >= LEAST_PAIRS]
    # A transformation garbles every character: beyond those the twins showed, Latin letters and general punctuation.
    alphabet = alphabet | {chr(c) for c in [*range(0xA0, 0x180), *range(0x2010, 0x2040), 0x20AC, 0x2122, 0x2020, 0x1E9E, 0xFB01, 0xFB02]}
    mapping: dict[str, str] = {}
    for encoding in accepted:
        for c in sorted(alphabet):
            wrong = read_wrong(c, encoding)
            if len(wrong) > 1 and NON_ASCII.fullmatch(wrong):
                mapping.setdefault(wrong, c)
    for garbled, clean, words, total in sorted(others):
        if garbled not in mapping and words >= LEAST_WORDS and words >= 0.9 * total and len(garbled) > 1 and looks_garbled(garbled):
            mapping[garbled] = clean
    return mapping


def learn(pairs: list[tuple[str, str, int]]) -> dict[str, str]:
    """:func:`settle` for pairs that are at hand."""
    votes: Counter[str] = Counter()
    alphabet: set[str] = set()
    best: dict[str, list] = defaultdict(list)
    for garbled, clean, words in pairs:
        found = explaining(garbled, clean)
        votes.update(found)
        alphabet.update(clean if found else "")
        best[garbled].append((words, clean, not found))
    others = [(g, max(own)[1], max(own)[0], sum(n for n, *_ in own)) for g, own in best.items() if max(own)[2]]
    return settle(votes, alphabet, others)


def looks_garbled(run: str) -> bool:
    """Letters or signs that never stand together in a word: an upper-case letter or a sign inside the run."""
    return any(c.isupper() or not c.isalpha() for c in run[:-1]) and any(0x80 <= ord(c) for c in run)


class Repair:
    """Applies a mapping: longest sequences first, again while the result is still garbled (text garbled twice)."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = mapping
        tree = "|".join(map(re.escape, sorted(mapping, key=lambda s: (-len(s), s))))
        self.find = re.compile(tree) if mapping else None
        starts = "".join(re.escape(c) for c in sorted({m[0] for m in mapping}))
        self.first = re.compile(f"[{starts}][^\\x00-\\x7f]") if mapping else None
        # A sequence may have lost its soft hyphen, or its no-break space may have become a space: what is left then
        # follows a small letter, where no upper-case letter or sign belongs.
        self.lost: dict[str, list] = defaultdict(list)
        for wrong, clean in sorted(mapping.items()):
            if len(wrong) == 2 and wrong[1] in "\xad\xa0" and not wrong[0].islower() and clean.islower():
                after = "(?=[a-zß-öø-ÿ])" if wrong[1] == "\xad" else r"(?=\s|$)(?: (?= ))?"
                self.lost[wrong[0]].append((re.compile(f"(?<=[a-zß-öø-ÿ’']){re.escape(wrong[0])}{after}"), clean))
        self.left = re.compile("[" + "".join(map(re.escape, sorted(self.lost))) + "](?=[\\x00-\\x7f]|$)") if self.lost else None

    def __call__(self, text: str | None) -> tuple[bool, bool, str | None]:
        """(affected, recovered, text)."""
        if not text or (text.isascii() and "&#" not in text):
            return False, False, text
        plain = references(text)
        broken = BROKEN.search(plain) is not None
        if self.find is None:
            return broken, False, text
        now, changed = plain, False
        for _ in range(3):
            if self.first.search(now) is None:  # cheap: a sequence is at least two characters beyond ASCII
                break
            fixed, n = self.find.subn(lambda m: self.mapping[m[0]], now)
            if not n:
                break
            now, changed = fixed, True
        for first in sorted(set(self.left.findall(now))) if self.left is not None else ():
            for pattern, clean in self.lost[first]:
                now, n = pattern.subn(clean, now)
                changed = changed or n > 0
        if not changed:
            return broken, False, text
        return True, BROKEN.search(now) is None, now


    def traced(self, text: str) -> Trace:
        """The same repair with the way back to the positions of ``text``."""
        out = Trace(text)
        out.sub(REFERENCE, referred)
        for _ in range(3):
            if self.find is None or self.first.search(out.text) is None or not out.sub(self.find, lambda m: self.mapping[m[0]]):
                break
        for first in sorted(set(self.left.findall(out.text))) if self.left is not None else ():
            for pattern, clean in self.lost[first]:
                out.sub(pattern, lambda m, clean=clean: clean)
        return out


def learned_mapping(pages: DataFrame) -> dict[str, str]:
    return mapping_of(word_counts(pages))


def mapping_of(words: DataFrame) -> dict[str, str]:
    """The mapping that all aligned pairs of the corpus vote for. Votes are counted where the pairs are; the driver gets
    one count an encoding, the distinct characters, and the runs no encoding explains that enough words support."""
    pairs = aligned_pairs(words)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [explaining(g, c) for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(by, pa.list_(pa.string()))], names=["garbled", "clean", "words", "by"])

    judged = cut_lineage(pairs.mapInArrow(explain, "garbled string, clean string, words long, by array<string>"))
    votes = {r["e"]: r["count"] for r in judged.select(F.explode("by").alias("e")).groupBy("e").count().collect()}
    characters = judged.filter(F.size("by") > 0).select(F.explode(F.split("clean", "")).alias("c")).distinct().collect()
    best = judged.groupBy("garbled").agg(F.max(F.struct("words", "clean", (F.size("by") == 0).alias("other"))).alias("b"), F.sum("words").alias("total"))
    others = best.filter((F.col("b.words") >= LEAST_WORDS) & F.col("b.other") & (F.length("garbled") > 1) & (F.col("b.words") >= 0.9 * F.col("total")))
    rows = collected(others.select("garbled", "b.clean", "b.words", "total"), MOST_RUNS, "garbled runs that no encoding explains")
    return settle(votes, {r["c"] for r in characters if r["c"]}, [tuple(r) for r in rows])


def repair_pages(pages: DataFrame, key: str = "page_key", mapping: dict[str, str] | None = None) -> DataFrame:
    """Affected rows of ``pages``: ``key``, ``recovered`` and the restored ``text``. Two scans; only words are shuffled."""
    mapping = learned_mapping(pages) if mapping is None else mapping

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(mapping)
        for batch in batches:
            keys, recovered, texts = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                affected, good, fixed = repair(text)
                if affected:
                    keys.append(k)
                    recovered.append(good)
                    texts.append(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(recovered, pa.bool_()), pa.array(texts, pa.string())], names=[key, "recovered", "text"])

    return pages.select(key, "text").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, recovered boolean, text string")


def only_twins(broken: DataFrame, words: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(word, clean): the words with U+FFFD of ``broken`` that exactly one clean word of ``words`` can stand for."""

    def keyed(kept: Callable[[str], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [w for w in batch.column(0).to_pylist() if kept(w)]
                rest = [NON_ASCII.sub("", w) for w in own]
                rows = [(r, len(w), w) for r, w in zip(rest, own) if any(c.isalpha() for c in r)]
                columns = list(zip(*rows)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], names=["rest", "size", "word"])

        return run

    repair = Repair(mapping)
    clean = words.select("word").mapInArrow(keyed(lambda w: BROKEN.search(w) is None and not repair(w)[0]), "rest string, size int, word string").withColumnRenamed("word", "clean")
    lost = broken.select("word").distinct().mapInArrow(keyed(lambda w: True), "rest string, size int, word string")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            fit = [(w, c) for w, c in pairs if all(a == b or (a == "\ufffd" and ord(b) > 127) for a, b in zip(w, c))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in fit], pa.string()) for i in range(2)], names=["word", "clean"])

    fit = lost.join(clean, ["rest", "size"]).select("word", "clean").mapInArrow(fitting, "word string, clean string")
    return fit.groupBy("word").agg(F.min("clean").alias("clean"), F.max("clean").alias("other")).filter("clean = other").drop("other")


def restore(pages: DataFrame, key: str = "page_key") -> DataFrame:
    """:func:`repair_pages`, with the words restored that U+FFFD broke and one clean word can stand for."""
    words = cut_lineage(word_counts(pages))
    mapping = mapping_of(words)
    repaired = cut_lineage(repair_pages(pages, key, mapping))
    kind = pages.schema[key].dataType.simpleString()

    def lost_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in {w for w in WORD.findall(text) if "\ufffd" in w}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array([w for _, w in rows], pa.string())], names=[key, "word"])

    broken = repaired.filter(F.col("text").contains("\ufffd")).select(key, "text").mapInArrow(lost_words, f"{key} {kind}, word string").distinct()
    twins = only_twins(broken, words, mapping)
    own = broken.join(twins, "word").groupBy(key).agg(F.collect_list(F.struct("word", "clean")).alias("twins"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recovered, texts = [], []
            for good, text, pairs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if pairs:
                    right = {p["word"]: p["clean"] for p in pairs}
                    text = WORD.sub(lambda m: right.get(m[0], m[0]), text)
                    good = BROKEN.search(text) is None
                recovered.append(good)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recovered, pa.bool_()), pa.array(texts, pa.string())], names=[key, "recovered", "text"])

    return repaired.join(own, key, "left").select(key, "recovered", "text", "twins").mapInArrow(put, f"{key} {kind}, recovered boolean, text string")


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return restore(table(spark, sf, "page_results")).dropDuplicates(["page_key"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair_pages(table(spark, sf, "page_results")).select("page_key").distinct()
