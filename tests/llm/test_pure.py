"""The algorithms themselves, against brute force, exact round trips and held-out data."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import encoding, language, percentiles, scan_noise, spam, split, tokens
from docmill.llm.bpe import encoder

EN = ["The ferry clerk keeps the spare keys under the stairs.", "We believe that nobody asked for the list of valves.", "Only twelve of them were found in the lower hall.", "Please note that it will be kept until further notice."]
ES = ["El conserje guarda las llaves de repuesto debajo de la escalera.", "Creemos que nadie pidió la lista de válvulas rotas.", "Sólo se encontraron doce piezas en la sala de abajo.", "Tenga en cuenta que se guardará todo hasta nuevo aviso."]


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return encoder(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \n\t\r\x85\xa0é中1'stdl\x1c​😀<|end>-", max_size=60))
def test_ids_equal_the_library(bpe, library, text):
    ids = bpe.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.automaton.decode(ids) == text and bpe.count(text) == len(ids)


@pytest.mark.parametrize("text", ["", None, "a" * 3000, " " * 500, "aaa ab" * 300, "<|endoftext|>", "Straße naïve 12345"])
def test_ids_of_odd_texts(bpe, library, text):
    assert bpe.encode(text) == (library.encode(text, add_special_tokens=False).ids if text else [])


def test_prefix_states_equal_whole_words(bpe):
    automaton, word, path, start, count = bpe.automaton, "", [-1], [0], [0]
    for piece in sorted([" walk", " walking", " walked", " wal", "walk", " walkers!"]):
        new = automaton.spell(piece)
        same = next((i for i, (a, b) in enumerate(zip(new, word)) if a != b), min(len(new), len(word)))
        del path[same + 1 :], start[same + 1 :], count[same + 1 :]
        automaton.extend(new, path, start, count)
        word = new
        assert count[-1] == len(automaton.encode_piece(piece))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda p: p[0]), st.integers(1, 4))
def test_buckets_are_optimal(pairs, k):
    from itertools import combinations

    pairs.sort()
    sizes, counts = (np.array(x, np.int64) for x in zip(*pairs))

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in pairs)

    best = min(padding([*c, sizes[-1]]) for n in range(min(k, len(sizes))) for c in combinations(sizes[:-1], n))
    got = tokens.bucket_bounds(sizes, counts, k)
    assert len(got) <= k and padding(got) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 30)), min_size=1, max_size=8, unique_by=lambda p: p[0]))
def test_plan_places_every_item_within_capacity(pairs):
    pairs.sort()
    bounds, counts = zip(*pairs)
    used, placed = {}, [0] * len(bounds)
    for b, first, k, times, at in tokens.container_plan(list(bounds), list(counts), 50):
        assert first == placed[b]
        placed[b] += k * times
        for c in range(at, at + times):
            used[c] = used.get(c, 0) + k * bounds[b]
    assert placed == list(counts) and max(used.values()) <= 50


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,|x", max_size=900), st.integers(32, 64), st.integers(0, 80), st.sampled_from(["table", "paragraph", "code", None]))
def test_pieces_cover_the_text(text, size, overlap, kind):
    pieces = split.cut(text, size, overlap, kind)
    assert "".join(text[new:end] for _, new, end in pieces) == text
    tail = 4 * min(overlap, size // 2)
    for start, new, end in pieces:
        assert (end - start) // 4 <= size and 0 <= new - start <= (tail if len(pieces) > 1 else 0)
        widest = max(0, new - tail) if len(pieces) > 1 else new  # the overlap starts at a word, unless it is inside one
        assert start == widest or text[start - 1].isspace() and not text[widest:start].isspace() or not text[start:new]
        assert start == 0 or start == new or text[start - 1].isspace() or not re.search(r"\s", text[start:new].rstrip()) or start == widest


def test_cuts_prefer_natural_boundaries():
    text = ("First part. It has two sentences.\n\n" * 8).strip()
    assert all(text[:new].endswith("\n\n") for _, new, _ in split.cut(text, 32, 0)[1:])
    table = "\n".join(f"| row {i} | {i} |" for i in range(60))
    assert all(text_end in (len(table),) or table[text_end - 1] == "\n" for _, _, text_end in split.cut(table, 32, 8, "table"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=300), st.integers(1, 5))
def test_small_summaries_are_exact_in_any_order(values, parts):
    total = percentiles.Buffers()
    for i in range(parts):
        own = percentiles.Buffers()
        own.add(np.array(values[i::parts]))
        total.merge(percentiles.Buffers.of(own.rows()))
    for q in (0, 0.5, 0.95, 1):
        assert np.isclose(total.quantile(q), np.quantile(values, q))


def test_sides_go_on_where_a_summary_was_stored():
    def taken(store):
        total = percentiles.Buffers()
        for part in np.split(np.arange(8.0 * percentiles.K), 8):
            total.add(part)
            total = percentiles.Buffers.of(total.rows()) if store else total
        return total

    a, b = taken(False), taken(True)
    assert {k for k, v in a.odd.items() if v} == set(b.odd) and all((a.levels[k] == b.levels[k]).all() for k in a.levels) and a.n == b.n


def test_rank_error_is_bounded():
    values = np.random.default_rng(1).lognormal(3, 2, 400_000)
    total = percentiles.Buffers()
    for part in np.array_split(values, 37):
        own = percentiles.Buffers()
        own.add(part)
        total.merge(percentiles.Buffers.of(own.rows()))
    assert total.n == len(values)
    values.sort()
    top = max(total.levels)
    for q in (0.01, 0.5, 0.9, 0.99):
        assert abs(np.searchsorted(values, total.quantile(q)) - q * len(values)) <= len(values) * top / (2 * percentiles.K) + 1


def test_languages_and_mixed_pages():
    model = language.Model([("en", t) for t in EN] + [("es", t) for t in ES])
    weights, runs = language.decide(model, [" ".join(EN[:2]) + " " + " ".join(ES[2:]), None, " \n", "12 34", " ".join(EN[:2]) + " " + ES[0]])
    assert [(r[1], r[3]) for r in runs[0]] == [("en", 2), ("es", 2)] and weights[1].sum() == weights[2].sum() == weights[3].sum() == 0
    assert [r[3] for r in runs[4]] == [2, 1]
    bits = model.score([language.fold(t) for t in EN + ES])
    assert [model.languages[i] for i in bits.argmin(1)] == ["en"] * 4 + ["es"] * 4
    assert language.decide(language.Model([]), ["some text"])[1] == [[]]


def test_stretches_stand_in_the_text():
    model = language.Model([("en", t) for t in EN] + [("es", t) for t in ES])
    page = "\n" + EN[0][:13] + "-\n" + EN[0][13:] + " " + EN[1] + "\n| 12 | key |\n\tab\n" + ES[0] + "\n" + ES[1] + "  \n"
    (first, second), blank, code, short = language.stretches(model, [page, " \n", "12 34", "the ferry clerk"])
    assert (first[0], first[2], second[2]) == (1, "en", "es") and page[second[0] : second[1]].endswith(ES[0] + "\n" + ES[1])
    assert page[first[0] : first[1]].startswith(EN[0][:13] + "-\n") and EN[1] in page[first[0] : first[1]] and not page[first[1] : second[0]].strip()
    assert 0 < first[3] <= 1 and 0 < second[3] <= 1 and blank == [] and code == [(0, 5, "und", 0.0)] and short[0][:3] == (0, 15, "en")
    assert language.stretches(language.Model([]), ["some text", None]) == [[(0, 9, "und", 0.0)], []]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-. \n\t|\"é", max_size=60))
def test_places_hold_the_segments(text):
    at = language.places(text)
    assert [language.JOIN.sub("", text[a:b]) for a, b in at] == [s.strip() for s in language.segments(text)]


def test_long_segments_have_exact_code_lengths(monkeypatch):
    model = language.Model([("en", t) for t in EN] + [("es", t) for t in ES])
    texts = [language.fold(" ".join(EN * 30)), language.fold("x" * 405 + EN[0] * 20), b"ab", b""]
    pieces = model.score(texts)
    monkeypatch.setattr(language, "PIECE", 1 << 30)
    assert np.allclose(pieces, model.score(texts), rtol=1e-5)


def test_table_of_contexts_stays_within_its_bound(monkeypatch):
    whole = language.Model([("en", t) for t in EN])
    monkeypatch.setattr(language, "TABLE_BYTES", whole.bits.nbytes // 2)
    model = language.Model([("en", t) for t in EN])
    assert model.bits.nbytes <= whole.bits.nbytes // 2
    assert np.allclose(np.exp2(-model.bits.reshape(-1, model.size, 1).astype(float)).sum(1), 1, atol=1e-3)


def test_code_lengths_are_probabilities():
    model = language.Model([("en", t) for t in EN])
    total = np.exp2(-model.bits.reshape(-1, model.size, 1).astype(float)).sum(1)
    assert np.allclose(total, 1, atol=1e-3)


WORDS = ["reunión", "próximo", "señal", "también", "está", "façade", "Größe", "déjà", "información", "música", "corazón", "árboles"]


@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_learned_mapping_restores(codec):
    pairs = [(g, c, 3) for w in WORDS for g, c in zip(encoding.runs(encoding.read_wrong(w, codec)), encoding.runs(w)) if g != c]
    repair = encoding.Repair(encoding.learn(pairs))
    text = "El almacén movió las llaves — “sí”. ¿Quién? É Ü"
    assert repair(encoding.read_wrong(text, codec)) == (True, True, text)
    assert repair(encoding.read_wrong(encoding.read_wrong("canción", codec), codec))[2] == "canción" or codec != "cp1252"
    for clean in (text, "NÃO HÁ SITUAÇÃO", "Â and Ã are letters; £ and © are signs.", "ÂTRE, PÂTÉ § 3", "", None, "plain"):
        assert repair(clean) == (False, False, clean)
    assert repair("refer�ncia")[0] and not repair("refer�ncia")[1]


def test_any_number_and_length_of_pairs_votes():
    long = "é" * 61
    many = [(encoding.read_wrong(chr(0x400 + i % 200), "cp1252") + "Ã" * (i // 200), chr(0x400 + i % 200), 1) for i in range(20_001)]
    mapping = encoding.learn([*many, (encoding.read_wrong(long, "cp437"), long, 1), *((encoding.read_wrong(c, "cp437"), c, 1) for c in "ñü")])
    assert mapping[encoding.read_wrong("ö", "cp437")] == "ö" and mapping[encoding.read_wrong("ж", "cp1252")] == "ж"


def test_numeric_references():
    repair = encoding.Repair(encoding.learn([(encoding.read_wrong(c, "cp1252"), c, 5) for c in "éóíñ"]))
    assert repair("reuni&#195;&#179;n")[2] == "reunión" and not repair("caf&#233;")[0]


def test_scan_helpers():
    assert scan_noise.uncut("ware-\nhouse, x - \nY, end-\n") == "warehouse, x - \nY, end-\n"
    assert scan_noise.reading("ab0ut", "about") is True and scan_noise.reading("becaiise", "because") is False and scan_noise.reading("papcr", "paper") is False
    assert scan_noise.reading("paper", "table") is None and scan_noise.reading("c|oud", "cloud") is True
    for line in ("- 12 -", "Page 3 of 9", "iv", "[114]", "Seite 1", "p. 2"):
        assert scan_noise.is_number(line), line
    for line in ("3.", "2025", "Scope", "sala", "40 since the last inspection"):
        assert not scan_noise.is_number(line), line
    assert scan_noise.edges("2   THE SPARE KEYS\nbody text.\n")[1]
    out = scan_noise.reflow("Head line\nThe ware-\nhouse is ab0ut\nfull.\n\nNext.\n- 3 -", {"ab0ut": "about"}, {"Head line"})
    assert out == "The warehouse is about full.\n\nNext."


def test_every_reading_shares_a_stroke_key_and_is_found():
    """Brute force: all words that signs and at most two edits of letters can make, without any bound on their number."""
    for word in ("clerk", "c1ini|l", "vvinning", "ruin", "groß", "m1n1|nuum", "x" * 50 + "rn1l"):
        forms = {""}
        for c in word:
            forms = {f + o for f in forms for o in ((c, *scan_noise.SIGNS[c]) if c == "ß" else scan_noise.SIGNS.get(c, (c,)))}
        forms = {f for f in forms if not scan_noise.ODD.search(f)}
        assert all(scan_noise.reading(word, f) is True for f in forms - {word})
        layer = set(forms)
        for _ in range(2):
            layer = {b[:i] + o + b[i + w :] for b in layer for i in range(len(b)) for w in (1, 2) for o in scan_noise.LETTERS.get(b[i : i + w], ()) if len(b[i : i + w]) == w}
            for f in list(layer)[:400]:
                assert f == word or scan_noise.reading(word, f) is not None, (word, f)
                assert f.translate(scan_noise.STROKES) in scan_noise.keys(word)


def test_long_words_and_two_running_lines():
    assert scan_noise.suspicious("a" * 41 + "0" + "b" * 20)
    found, _ = scan_noise.edges("ANNUAL NOTES OF THE HARBOUR " * 5 + "\nSection of the pilots\n\nBody text.\n")
    assert [depth for *_, depth in found] == [0, 1] and len(found[0][0]) > 110


def test_further_vectors_under_learned_contexts():
    counts = np.zeros((4, 4))
    counts[0, 1] = counts[1, 0] = counts[2, 3] = counts[3, 2] = 500
    _, c = scan_noise.skip_gram(counts)
    (v,) = scan_noise.fold_in(np.array([[0, 40, 0, 0]]), c, counts.sum(0))
    assert v @ c[1] > 0 > v @ c[3]


def test_vectors_prefer_seen_neighbours():
    counts = np.zeros((4, 4))
    counts[0, 1] = counts[1, 0] = counts[2, 3] = counts[3, 2] = 500
    w, c = scan_noise.skip_gram(counts)
    assert w[0] @ c[1] > 0 > w[0] @ c[3]


@pytest.fixture(scope="module")
def labeller():
    return spam.Labeller([f"{t} {u}" for t in EN + ES for u in EN])


def message(body, **fields):
    return "\n".join(f"{k.replace('_', '-')}: {v}" for k, v in {"From": "a@b.example", **fields}.items()) + "\n\n" + body


def test_stuffed_messages(labeller):
    words = "cheap shoes price deal online".split()
    r = random.Random(2)
    tags = ", ".join(r.choice(words) for _ in range(80))
    links = "\n".join(f"{r.choice(words)} {r.choice(words)}: https://{r.choice(words)}.test/p/{i}" for i in range(20))
    for body in (EN[0] + "\n" + tags, EN[0] + "\n" + links, "\n".join("#" + w for w in words * 9)):
        share, n, _ = labeller.judge(message(body))
        assert share > spam.LEAST_SHARE and n > 0, body[:40]
    short = "cheap shoes deal cheap price shoes cheap deal"  # eight words
    assert labeller.judge(message(", ".join(short.split())))[0] > spam.LEAST_SHARE
    prose = "\n".join(f"{a} {b}\n  https://x.example/{i}" for i, (a, b) in enumerate(zip(EN * 2, EN[::-1] * 2)))
    assert labeller.judge(message(prose))[0] < 0.4
    for nothing in (None, "", " \n"):
        assert labeller.judge(nothing) == (0.0, 0, [0] * 4)


def test_own_text():
    assert spam.own_text(message("Hi=20there =E2=82=AC", Content_Transfer_Encoding="quoted-printable")).strip() == "Hi there €"
    assert spam.own_text(message("SGVsbG8gdGhlcmU=", Content_Transfer_Encoding="base64")) == "Hello there"
    multi = '--x\nContent-Type: text/plain\n\nplain part\n--x\nContent-Type: text/html\n\n<p>html</p>\n--x--\n'
    assert spam.own_text(message(multi, Content_Type='multipart/alternative; boundary="x"')).strip() == "plain part"
    assert spam.own_text(message("new\n\nOn 1.2.2026, A wrote:\n> old\n")).strip() == "new"
    assert "u.test" in spam.own_text(message("<div><a href='http://u.test'>cheap</a></div>")) and spam.own_text("no headers here") == "no headers here"


def test_own_text_of_nested_and_several_parts():
    deep = "words"
    for i in range(6):
        kind = f'Content-Type: multipart/mixed; boundary="b{i - 1}"' if i else "Content-Type: text/plain"
        deep = f"--b{i}\n{kind}\n\n{deep}\n--b{i}--\n"
    assert spam.own_text(message(deep, Content_Type='multipart/mixed; boundary="b5"')).strip() == "words"
    two = '--x\nContent-Type: text/plain\n\nfirst\n--x\nContent-Type: text/plain\n\nsecond\n--x\nContent-Type: text/plain\nContent-Disposition: attachment\n\nfile\n--x--\n'
    assert spam.own_text(message(two, Content_Type='multipart/mixed; boundary="x"')).split() == ["first", "second"]
    note = "This message is meant for its reader. " * 30
    assert spam.own_text(message(f"new\n\n***\n{note}")).strip() == "new"


@pytest.fixture(scope="module")
def finder():
    from docmill.llm import personal, personal_samples

    lexicon = [("Ada", "given"), ("Marta", "given"), ("Owen", "given"), ("Luc", "given"), ("Stone", "family"), ("Quillfast", "family"), ("Barrolla", "family"), ("Montserel", "family")]
    before, personal.TRAINING_LINES = personal.TRAINING_LINES, 4000
    made = personal.opened(personal.train(lexicon, EN * 5 + ES * 5, "fit"))
    personal.TRAINING_LINES = before
    return made, personal_samples.Composer(lexicon, EN + ES, seed=77, part="held_out")


def test_personal_on_labels_and_passages_not_fitted(finder):
    find, composer = finder
    lines = [composer.line() for _ in range(1200)]
    found = find.find([text for text, _ in lines])
    for kind in ("email", "phone", "id_number", "address", "name"):
        true = [i for i, (_, truth) in enumerate(lines) if truth and truth[0][2] == kind]
        seen = [i for i, spans in enumerate(found) if any(s[2] == kind for s in spans)]
        both = set(true) & set(seen)
        assert len(both) >= 0.75 * len(true) and len(both) >= 0.7 * len(seen), (kind, len(true), len(seen), len(both))


def test_redaction_keeps_the_rest(finder):
    from docmill.llm.personal import redact

    find, _ = finder
    text = "Name: Marta Barrolla\nE-mail owen.stone (at) desk (dot) example\nCall +34 600 555 703 today. Order 558-29. [EMAIL]"
    garbled = "sÃ­, cafÃ© &#195;&#169; info@x.example maÃ±ana, MÃ¼ller@x.example"
    found = find.find([text, None, "", garbled])
    out = redact(text, found[0])
    assert out.startswith("Name: [NAME]\nE-mail [EMAIL]\nCall [PHONE] today. Order 558-29") and out.endswith("[EMAIL]")
    assert found[1] == found[2] == [] and redact(garbled, found[3]) == "sÃ­, cafÃ© &#195;&#169; [EMAIL] maÃ±ana, [EMAIL]"
    assert all(re.fullmatch(r"[a-z_]+", s[2]) for s in found[0])


def test_values_longer_than_the_windows():
    from docmill.llm import personal

    words = personal.Words([], [])
    street = "Calle de Quinmenralgarbertolandrasquintorvalmenral Ferralgarbertolandrasquin 12, 00123 Garbertolandrasquintorvalmenralgarber Ferralgarbertolandras"
    found = personal.candidates(f"He lives at {street}.", words)
    assert any(k == "address" and b - a == len(street) for a, b, k in found)


def test_candidates_in_rarer_spellings():
    from docmill.llm import personal

    words = personal.Words([], [])
    for text in ("write to owen.stone at desk.example today", "owen.stone (Arroba) desk.example", "owen.stone [ARROBA] desk.example", "owen.stone at desk\ndot\nexample", "owen.stone At desk Dot example", "owen.stone at desk.example; marta at host dot example"):
        assert any(k == "email" and text[a:b].startswith("owen.stone") and text[a:b].endswith("example") for a, b, k in personal.candidates(text, words)), text
    assert not any(k == "email" for _, _, k in personal.candidates("She lives at P.O. Box 12, Overton.", words))
    for street in ("Calle Mayor, n.12", "Calle Mayor, nº12", "Calle Mayor, n.º12", "Calle Mayor, núm.12", "Calle Mayor, número12", "Calle Mayor  12", "Calle Mayor2 12", "Postfach  12"):
        text = f"He lives at {street} now"
        assert any(k == "address" and text[a:b] == street for a, b, k in personal.candidates(text, words)), street
