"""Problem 10: keyword-stuffed and link-list messages.

A message is reduced to its own body (headers, other parts, quotes, signature and disclaimer aside, transfer encoding and
HTML undone) and its lines are labelled prose, link list, tag list or menu by a hidden Markov model over binary line
features. Emissions and transitions are counted on labelled lines: passages of certain language as prose, and lists
composed of their words. A message is flagged if most words of its body stand in lines that aren't prose.

Defined results: null, empty and blank texts, and bodies without words, are never flagged; a body of any other length is
judged; a text without headers is all body; a body cut off in its encoding is read as far as it goes. Every row is judged
by itself.
"""

from __future__ import annotations

import base64
import html
import pickle
import quopri
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.ranking import drawn
from docmill.session import table

STATES = ("prose", "links", "tags", "menu")
LEAST_SHARE = 0.5
MOST_SAMPLES = 5_000  # bound of the labelled passages, drawn by hash

HEADER = re.compile(r"^[A-Za-z][A-Za-z-]*:[ \t]?.*$")
FIELD = re.compile(r"^([A-Za-z][A-Za-z-]*):[ \t]?(.*(?:\n[ \t].*)*)", re.M)
BOUNDARY = re.compile(r'boundary="?([^"\s;]+)', re.I)
CHARSET = re.compile(r'charset="?([\w-]+)', re.I)
LINK = re.compile(r'<a\b[^>]*?href\s*=\s*["\']?([^"\'\s>]+)[^>]*>(.*?)(?:</a>|$)', re.I | re.S)
BREAK = re.compile(r"<(?:br|/p|/div|/li|/tr|/h\d|p|div|li|tr|h\d|hr|table|ul|ol)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]+>")
HIDDEN = re.compile(r"<(script|style|head)\b.*?</\1>", re.I | re.S)
URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
WORD = re.compile(r"[^\W\d_]{2,}")
REPLY = re.compile(r"^(?:.{0,200}(?:wrote|schrieb.{0,80}|écrit|escribió|escreveu|scritto)\s?:\s*$|-{2,}\s?(?:original|ursprüngliche|mensaje|message|messaggio|mensagem|forwarded|weitergeleitete|doorgestuurd).*$|_{10,}$)", re.I | re.M)
DISCLAIMER = re.compile(r"^\*{3,}\s*$", re.M)
ITEM = re.compile(r"[,;|#·•>/\t]|&middot;| - ")


def decoded(body: str, encoding: str, content_type: str) -> str:
    """Undo a transfer encoding; what is cut off or malformed is read as far as it goes."""
    encoding = encoding.strip().lower()
    if encoding not in ("quoted-printable", "base64"):
        return body
    named = CHARSET.search(content_type)
    try:
        if encoding == "base64":
            bare = re.sub(r"[^A-Za-z0-9+/]", "", body)
            bare = bare[:-1] if len(bare) % 4 == 1 else bare  # cut off inside a byte
            raw = base64.b64decode(bare + "=" * (-len(bare) % 4))
        else:
            raw = quopri.decodestring(body.encode("utf-8", "replace"))
        return raw.decode(named[1] if named else "utf-8", "replace")
    except (ValueError, LookupError):
        return body


def split_head(message: str) -> tuple[dict[str, str], str]:
    first = message.lstrip("\r\n").split("\n", 1)[0]
    if not HEADER.match(first) or first.lower().startswith(("http:", "https:")):
        return {}, message
    head, _, body = message.lstrip("\r\n").partition("\n\n")
    return {k.lower(): v for k, v in FIELD.findall(head)}, body


def parts_of(fields: dict[str, str], body: str) -> list[tuple[dict[str, str], str]]:
    """The text parts of a message that a reader sees, in order, however deep they are nested.

    Of alternatives the plain one is taken, or the first where none is plain; of other parts all that are text and no
    attachment. A message inside the message isn't its own body. A cut-off multipart is read as far as it goes.
    """
    out, todo = [], [(fields, body)]
    while todo:
        fields, body = todo.pop()
        kind = fields.get("content-type", "text/plain").lower()
        limit = BOUNDARY.search(fields.get("content-type", "")) if kind.startswith("multipart/") else None
        if limit is None or "--" + limit[1] not in body:
            if kind.startswith(("text/", "multipart/")) or "/" not in kind:
                out.append((fields, body))
            continue
        inner = [split_head(p.lstrip("-").lstrip("\n") if not p.startswith("\n") else p[1:]) for p in body.split("--" + limit[1])[1:]]
        inner = [p for p in inner if p[1].strip() and not p[0].get("content-disposition", "").lower().lstrip().startswith("attachment")]
        texts = [p for p in inner if p[0].get("content-type", "text/plain").lower().startswith(("text/", "multipart/"))] or inner[:1]
        if kind.startswith("multipart/alternative"):
            texts = ([p for p in texts if "html" not in p[0].get("content-type", "").lower()] or texts)[:1]
        todo += reversed(texts)
    return out


def own_text(message: str) -> str:
    """The text of a message's own body."""
    message = message.replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(own_part(fields, body) for fields, body in parts_of(*split_head(message)))


def own_part(fields: dict[str, str], body: str) -> str:
    """One text part, readable, without what others wrote, signature and disclaimer."""
    kind = fields.get("content-type", "")
    body = decoded(body, fields.get("content-transfer-encoding", ""), kind)
    if "html" in kind.lower() or re.search(r"<(?:a|div|p|br|table|html)\b", body, re.I):
        body = HIDDEN.sub(" ", body)
        body = LINK.sub(lambda m: f" {TAG.sub(' ', m[2])}: {m[1]}\n", body)
        body = html.unescape(TAG.sub(" ", BREAK.sub("\n", body)))
    reply = REPLY.search(body)
    if reply is not None and reply.start() > 0:
        body = body[: reply.start()]
    body = re.split(r"^-- ?$", body, maxsplit=1, flags=re.M)[0]
    stars = list(DISCLAIMER.finditer(body))
    if stars and "\n\n" not in body[stars[-1].end() :].strip():  # a last paragraph under a line of stars
        body = body[: stars[-1].start()]
    return "\n".join(x for x in body.split("\n") if not x.lstrip().startswith(">"))


class Labeller:
    """The hidden Markov model and the function words it knows prose by."""

    def __init__(self, passages: list[str], seed: int = 11) -> None:
        seen: Counter[str] = Counter()
        for p in passages:
            seen.update({w for w in WORD.findall(p.lower())})
        least = max(2, len(passages) // 60)
        self.function = {w for w, n in seen.items() if n >= least and len(w) <= 4}
        lines, labels = self._samples(passages, random.Random(seed))
        x = [self.features(message) for message in lines]
        ones = np.ones((len(STATES), len(x[0][0][1])))
        total = np.full(len(STATES), 2.0)
        moves = np.full((len(STATES), len(STATES)), 1.0)
        first = np.ones(len(STATES))
        for rows, own in zip(x, labels):
            first[own[0]] += 1
            for a, b in zip(own, own[1:]):
                moves[a, b] += 1
            for (_, f, _), s in zip(rows, own):
                ones[s] += f
                total[s] += 1
        p = ones / total[:, None]
        self.on, self.off = np.log(p), np.log(1 - p)
        self.first = np.log(first / first.sum())
        self.moves = np.log(moves / moves.sum(1, keepdims=True))

    def _samples(self, passages: list[str], r: random.Random) -> tuple[list[str], list[list[int]]]:
        """Composed messages and the label of each line."""
        words = [w for p in passages for w in WORD.findall(p)] or ["word"]
        words = [w for w in words if w.lower() not in self.function] or words  # lists are made of content words
        messages, labels = [], []
        for _ in range(600):
            few = r.sample(words, min(len(words), r.choice((3, 5, 9, 14, 40))))
            text, own = [], []
            prose = lambda: r.choice(passages)
            pick = lambda n: [r.choice(few) for _ in range(n)]
            host = lambda: f"http{r.choice(('', 's'))}://{r.choice(words).lower()}.{r.choice(('com', 'org', 'test', 'net'))}/{r.choice(words).lower()}{r.choice(('', '/x', '?id=7'))}"
            style = r.randrange(10)
            for _ in range(r.randint(2, 8) if style == 0 else r.choice((0, 0, 1, 2, 3)) if style < 7 else r.randint(1, 3)):
                text.append(prose())
                own.append(0)
                if style == 0 and r.random() < 0.4:  # a link below a paragraph of a newsletter
                    text.append("  " + host())
                    own.append(1)
            for _ in range(r.randint(1, 25) if style else 0):
                if style in (1, 2):
                    text.append(r.choice([f"{' '.join(pick(2))}: {host()}", f"{host()}", f"{' '.join(pick(3))} {host()}", f"- {host()} {r.choice(few)}"]))
                    own.append(1)
                elif style in (3, 4):
                    mark = r.choice([", ", " ", " | ", "; ", " #"])
                    some = pick(r.randint(6, 60)) if mark != " #" else [r.choice(r.choice((few, words))).lower() + r.choice(["", r.choice(words).lower()]) for _ in range(r.randint(6, 60))]
                    text.append("#" * (mark == " #") + mark.join(some))
                    own.append(2)
                elif style in (5, 6):
                    text.append(r.choice([f"{'; '.join(pick(3))}; XL; {r.randint(9, 999)} €", f"{' '.join(pick(r.randint(2, 5)))} {r.randint(2000, 2030)}", f"{r.randint(2000, 2030)} {' '.join(pick(3))}", f"{r.choice(few)} {r.choice(few).upper()} {r.choice(words).capitalize()}", f"{' > '.join(pick(4))}", f"{r.choice(few)} - ${r.randint(1, 99)}.99"]))
                    own.append(3)
                elif style == 8:  # a table of a report
                    text.append(r.choice(["|---|---|", "| " + " | ".join([r.choice(words) + r.choice(["", " " + r.choice(words), "@" + r.choice(words).lower() + ".com"]) for _ in range(r.randint(1, 4))] + [str(r.randint(1, 4000))]) + " |"]))
                    own.append(0)
                elif style == 9:  # contact lines below a note
                    text.append(r.choice([f"{r.choice(words)}: +{r.randint(10, 99)} {r.randint(10000, 99999)} {r.randint(100, 999)}", f"{r.choice(words).capitalize()} {r.choice(words).capitalize()}", f"{r.choice(words).lower()}@{r.choice(words).lower()}.com", f"{r.choice(words).capitalize()} {r.randint(1, 99)}, {r.randint(10000, 99999)} {r.choice(words).capitalize()}"]))
                    own.append(0)
                    if len(text) > 6:
                        break
                else:  # entries of a report with a word or two
                    text.append(f"- {' '.join(prose().split()[:r.randint(4, 7)])}: {r.randint(1, 4000)}")
                    own.append(0)
            messages.append("\n".join(text))
            labels.append(own)
        return messages, labels

    def features(self, body: str) -> list[tuple[str, np.ndarray, int]]:
        """(line, features, words) of the filled lines; the words of link targets count."""
        lines = [x for x in body.split("\n") if x.strip()]
        bags = [[w.lower() for w in WORD.findall(URL.sub(" ", x))] for x in lines]
        seen = Counter(w for bag in bags for w in bag)
        size = sum(seen.values())
        many = {w for w, n in seen.items() if n >= 3 and n >= 0.02 * size and w not in self.function}
        out = []
        for line, bag in zip(lines, bags):
            urls = URL.findall(line)
            bare = line.strip()
            n = len(bag)
            known = sum(w in self.function for w in bag)
            marks = len(ITEM.findall(bare)) - 4 * len(urls)
            f = np.array([
                bool(urls), bool(urls) and n <= 6 * len(urls), bare[-1] in ".!?…:,\"”»" and not urls, n >= 6, known >= 0.15 * n and n > 0, known >= 0.3 * n and n > 0, marks >= 0.3 * max(n, 1), sum(w in many for w in bag) >= 0.5 * max(n, 1), n < 5, "#" in bare, len(set(bag)) <= 0.5 * n, sum(c.isdigit() for c in bare) >= 0.12 * len(bare), bare[:1].isupper(), n > 0 and known == 0, bare[0] == "|" and bare[-1] == "|", "@" in bare,
            ], float)
            out.append((line, f, n + sum(len(WORD.findall(u)) for u in urls)))
        return out

    def labels(self, rows: list[tuple[str, np.ndarray, int]]) -> list[int]:
        """The likeliest sequence of labels (Viterbi)."""
        f = np.stack([r[1] for r in rows])
        emit = (f @ self.on.T + (1 - f) @ self.off.T).tolist()
        moves, k = self.moves.tolist(), range(len(STATES))
        score, back = [a + b for a, b in zip(self.first.tolist(), emit[0])], []
        for e in emit[1:]:
            step = [max((score[a] + moves[a][b], a) for a in k) for b in k]
            back.append([a for _, a in step])
            score = [s + x for (s, _), x in zip(step, e)]
        path = [max(k, key=lambda a: score[a])]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]

    def judge(self, message: str | None) -> tuple[float, int, list[int]]:
        """(share of words outside prose, words, words a state) of a message."""
        if not message or message.isspace():
            return 0.0, 0, [0] * len(STATES)
        rows = self.features(own_text(message))
        held = [0] * len(STATES)
        if rows:
            for (_, _, n), s in zip(rows, self.labels(rows)):
                held[s] += n
        total = sum(held)
        return (1 - held[0] / total if total else 0.0), total, held


_OPEN: dict[int, Labeller] = {}


def opened(blob: bytes) -> Labeller:
    key = hash(blob)
    if key not in _OPEN:
        _OPEN[key] = pickle.loads(blob)
    return _OPEN[key]


def line_shares(documents: DataFrame, samples: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per message: ``key``, n_words, non_prose (share), and words by label. One scan without a shuffle."""
    passages = drawn(samples.filter("text is not null").select(F.lit(0).alias("all"), "text"), "all", "text", MOST_SAMPLES)
    passages = [r["text"] for r in passages.orderBy("text").collect()]
    sent = documents.sparkSession.sparkContext.broadcast(pickle.dumps(Labeller(passages or ["It is late."])))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = opened(sent.value).judge
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [judge(t) for t in part.column(1).to_pylist()]
                held = [pa.array([h[i] for _, _, h in out], pa.int32()) for i in range(len(STATES))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n, _ in out], pa.int32()), pa.array([s for s, _, _ in out], pa.float64()), *held], names=[key, "n_words", "non_prose", *STATES])

    return documents.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words int, non_prose double, " + ", ".join(f"{s} int" for s in STATES))


def p10_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_shares(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_lines(spark, sf).filter((F.col("n_words") > 0) & (F.col("non_prose") > LEAST_SHARE)).select("doc_id").distinct()
