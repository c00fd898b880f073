"""PDF and image files around plugged-in libraries: which pages are recognised, which text is kept, and what is warned of.

A parser gives a PDF's own pages, a recogniser reads a picture, a layout engine reads runs of pages as a whole. None is part
of this package; without one, files that need it end with ``NO_ADAPTER``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

from docmill.functions import markdown as M
from docmill.operators import layout
from docmill.sources import exif

#: Limits of the page decisions (fixed values).
MOST_PAGES, MOST_FRAMES, LEAST_VISIBLE, MOSTLY_IMAGE, LITTLE_TEXT, LEAST_COVERED, LOW_CONFIDENCE, PAGES_AT_ONCE, LOW_SIDE = 500, 200, 25, 0.6, 200, 0.9, 60, 4, 300
PLUGGED: dict[str, Any] = {}


class Unreadable(Exception):
    """A file that can't be read; ``code`` is its error code."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


def plug(kind: str, function: Callable | None) -> None:
    """``parser``: bytes -> list of pages (text, spans, tables, coverage, picture: () -> bytes). ``recogniser``: bytes ->
    (text, markdown, confidence, rotated). ``frames``: bytes -> list of pictures. ``layout``: (bytes, first, last, whole
    pages?) -> list of (text, markdown). None takes it out again."""
    if function is None:
        PLUGGED.pop(kind, None)
    else:
        PLUGGED[kind] = function


def page_of(number: int, text: str, markdown: str, method: str, confidence: float | None = None) -> dict:
    return {"number": number, "text": text, "markdown": markdown or M.from_lines(text), "method": method, "ocr_confidence": confidence}


def wants_recognition(mode: str, native: str, coverage: float) -> bool:
    """One page's :func:`docmill.operators.layout.needs_recognition`."""
    bare = "".join(native.split())
    return mode == "force" or (mode == "auto" and (len(bare) < LEAST_VISIBLE or (coverage > MOSTLY_IMAGE and len(native) < LITTLE_TEXT)))


def covered(markdown: str, text: str) -> float:
    """Share of a text's words that its Markdown holds, as multisets."""
    words = lambda s: Counter(re.findall(r"\w+", s.lower()))
    own = words(text)
    return (own & words(markdown)).total() / own.total() if own else 1.0


def font_sizes(pages: list[dict]) -> tuple[float, list[float]]:
    """The body size and the heading sizes of a document's first pages, as :func:`docmill.operators.layout.font_profile`."""
    held: Counter = Counter()
    for p in pages[:30]:
        for s in p.get("spans", ()):
            if s["text"].strip():
                held[round(s["size"] * 2) / 2] += len(s["text"].strip())
    if not held:
        return 0.0, []
    body = min(held, key=lambda k: (-held[k], k))
    return body, sorted((k for k, n in held.items() if k >= layout.HEADING_SIZE * body and n < 0.3 * held.total()), reverse=True)[:3]


def said_of(number: int | None, *warnings: str) -> list[str]:
    return [f"page {number}: {w}" if number else w for w in warnings]


def recognised(picture: bytes, number: int, info: dict) -> dict:
    if "recogniser" not in PLUGGED:
        raise Unreadable("NO_ADAPTER", "no recogniser is plugged in")
    got = PLUGGED["recogniser"](picture)
    confidence = got.get("confidence")
    if confidence is not None and confidence < LOW_CONFIDENCE:
        info["warnings"] += said_of(number, f"recognised with low confidence ({confidence:.0f})")
    if got.get("rotated"):
        info["warnings"] += said_of(number, f"turned by {got['rotated']} degrees before it was read")
    return page_of(number, got["text"], got.get("markdown", ""), f"ocr:{got.get('engine', 'plugged')}", confidence)


def read_pdf(raw: bytes, info: dict) -> list[dict]:
    """Every page by its own text, or recognised where it has next to none; in ``auto`` the longer text is kept. Markdown
    comes from spans; where it lost words, it is the plain text's."""
    if info.get("pipeline") == "layout" and "layout" in PLUGGED:
        return list(by_layout(raw, info))
    if info.get("pipeline") == "layout":
        info["warnings"].append("no layout engine is plugged in, read the standard way")
    if "parser" not in PLUGGED:
        raise Unreadable("NO_ADAPTER", "no PDF parser is plugged in")
    native, mode, out, empty = PLUGGED["parser"](raw), info.get("ocr_mode", "auto"), [], []
    if not native:
        raise Unreadable("CORRUPTED_FILE", "no pages")
    if len(native) > MOST_PAGES:
        raise Unreadable("LIMIT_EXCEEDED", f"{len(native)} pages, {MOST_PAGES} at most")
    body, levels = font_sizes(native)
    for number, p in enumerate(native, 1):
        text = p["text"].strip()
        if wants_recognition(mode, text, p.get("coverage", 0.0)):
            got = recognised(p["picture"](), number, info)
            if mode != "auto" or len(text) <= len(got["text"]):
                out.append(got)
                empty += [] if got["text"].strip() else [number]
                continue
        elif mode == "off" and len(text) < LEAST_VISIBLE:
            info["warnings"] += said_of(number, "hardly any text, and recognition is off")
        blocks = [layout.visual_lines(list(run), p.get("tables", ())) for _, run in groupby(p.get("spans", ()), key=lambda s: s.get("block", 0))]
        shaped = layout.page_markdown(blocks, body, levels, p.get("tables", ())) if any(blocks) or p.get("tables") else ""
        if shaped and covered(shaped, text) < LEAST_COVERED:
            info["warnings"] += said_of(number, "layout lost words, shown as plain text")
            shaped = ""
        out.append(page_of(number, text, shaped, "text_layer"))
        empty += [] if text else [number]
    if empty:
        info["warnings"].append(f"no text on page {page_list(empty)}")
    return out


def page_list(numbers: list[int]) -> str:
    """Runs of page numbers: 1-3, 5."""
    runs = ([n for _, n in run] for _, run in groupby(enumerate(numbers), key=lambda x: x[1] - x[0]))
    return ", ".join(str(r[0]) if len(r) == 1 else f"{r[0]}-{r[-1]}" for r in runs)


def by_layout(raw: bytes, info: dict) -> Iterator[dict]:
    """Runs of some pages at a time; a run with a page that has no text of its own is recognised whole."""
    native = PLUGGED["parser"](raw) if "parser" in PLUGGED else [{"text": ""}]
    scanned = [len("".join(p["text"].split())) < LEAST_VISIBLE for p in native]
    for at in range(0, len(native), PAGES_AT_ONCE):
        own = scanned[at : at + PAGES_AT_ONCE]
        for i, got in enumerate(PLUGGED["layout"](raw, at + 1, at + len(own), any(own))):
            yield page_of(at + i + 1, got["text"], got["markdown"], "layout:plugged" + ("+ocr" if own[i] else ""))


def read_image(raw: bytes, info: dict) -> list[dict]:
    """Every frame of a picture; of an animation the first."""
    if info.get("ocr_mode", "auto") == "off":
        info["warnings"].append("a picture has text by recognition alone, and that is off")
        return [{"number": 1, "text": "", "markdown": "", "method": "none", "ocr_confidence": None}]
    if info.get("pipeline") == "layout" and "layout" in PLUGGED:
        return list(by_layout(raw, info))
    info["metadata"] |= {f"exif_{k.lower()}": v for k, v in exif.facts(raw).items()}
    frames = PLUGGED["frames"](raw) if "frames" in PLUGGED else [raw]
    if len(frames) > MOST_FRAMES:
        raise Unreadable("LIMIT_EXCEEDED", f"{len(frames)} frames, {MOST_FRAMES} at most")
    if raw.startswith(b"GIF8") and len(frames) > 1:
        frames = frames[:1]
        info["warnings"].append("animation, the first frame was read")
    pages = [recognised(frame, i, info) for i, frame in enumerate(frames, 1)]
    empty = [p["number"] for p in pages if not p["text"].strip()]
    if empty:
        info["warnings"].append(f"no text in frame {page_list(empty)}")
    return pages
