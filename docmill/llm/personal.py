"""Problem 1: personal information inside free text.

High-recall generators propose overlapping spans (mail addresses, number runs, postal addresses, sequences of capitalised
words); one boosted-tree model a type scores them by format and context; spans above the type's calibrated threshold are
selected, the surest first, and replaced with typed placeholders. The models are fit on the driver on labelled sentences
that :mod:`docmill.llm.personal_samples` composes, ``TRAINING_LINES`` of them; the name lexicon is one feature among others.

Defined results: null, empty and blank texts hold nothing and stay as they are; text decoded wrongly is searched as it
would read, and what is outside the placeholders stays as it was; placeholders already there are no findings; in
``p1_found`` a repeated row is one record.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.boosting import Boosted
from docmill.llm.encoding import READ_AS, Repair, Trace, read_wrong
from docmill.llm.personal_samples import TITLE_WORDS, labelled_lines
from docmill.llm.ranking import collected, drawn
from docmill.session import table

TYPES = ("email", "phone", "id_number", "address", "name")
MOST_LEXICON = 1_000_000  # the lexicon is used whole; a larger one is an error
MOST_PASSAGES = 1_000  # passages of each language that lines are composed from, drawn by hash
TRAINING_LINES = 12_000

L = "a-zß-öø-ÿāăąćčďđėęěğģīķłńňőœřśşšťūůűųźżž"
U = "A-ZÀ-ÖØ-ÞĀĄĆČĎĐĒĘĚĢĪĶŁŃŇŐŒŘŚŞŠŤŪŮŰŹŻŽẞ"
CAP = rf"(?:[dDlL][’'])?[{U}](?:[{U}{L}0-9@!†°ﬁﬂ|]{{0,30}}[{U}{L}]|(?=[’'-]))(?:[’'-][{U}{L}][{U}{L}@!†°01]{{0,30}}){{0,4}}"
PARTICLE = r"(?:do|da|de|del|della|di|dos|das|von|van|der|den|zu|le|la|du|des|e|y)"
TITLE = r"(?:M(?:r|rs|s|me|lle)\.?|Miss|Dr\.?(?:\s?[ªa]\.?)?|Dra\.?|Prof\.?(?:\s?ssa)?|Sir|Herrn?|Frau|Monsieur|Madame|Maître|Sr\.?ª?|Sra\.?|Srta\.?|D\.ª?|Don|Doña|Dona|Sig\.?(?:ra|na)?|Signor[ae]?|Dott\.?(?:ssa)?|Ing\.?|Avv\.?|Eng\.?ª?|M\.)"
#: The sign of a mail address in its written forms, what stands before it and what follows.
SIGN = re.compile(r"[@(\[{<](?:(?<=@)|(?i:at|a|arroba|chiocciola)[)\]}>])")
SPOKEN = re.compile(r"(?<=\w)[ \n](?:at|arroba|chiocciola)[ \n](?=[\w-]+(?:\.\w|[ \n](?:dot|punto)[ \n]))", re.I)
LOCAL = re.compile(r"\w[\w.+\-]*[ \n]?$")
DOMAIN = re.compile(r"[ \n]?[\w-]+(?:(?:\.|[ ]\.[ ]?|[ \n]?(?:\((?:dot|punto|point|punkt|ponto)\)|\[(?:dot|punto|point|punkt|ponto)\]|\{dot\}|[ \n](?:dot|punto)[ \n])[ \n]?)[\w-]+)+", re.I)
LAST_LABEL = re.compile(r"[\w-]{2,}$")  # a domain ends with at least two letters: "lives at P.O. Box" has none
NUMBER = re.compile(r"(?<![\w@/+.,-])(?:\(?\+|\()?(?:[A-Z]{1,2}[ \-]?)?\d(?:(?:[ \n.\-/\u00a0]|[ ]?\(|\)[ .\-/]?|[ ][-/][ ])?\d){4,17}(?:-?[A-Z]{1,2}(?![\w])|[ ][A-Z](?![\w])|[ ]\d[ ]?[A-Z]{2}\d)?(?![\w@])")
DECIMAL = re.compile(r"\d{1,7}[.,]\d{1,4}")  # an amount, whatever surrounds it
CODE = re.compile(r"(?<![\w/-])(?:(?=[A-Z]*\d)(?=(?:[A-Z]*\d){5})[A-Z0-9]{8,16}|[A-Z]{1,2}[ -]?\d{6,9}[ -]?[A-Z]?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w/-])")
#: Digits are rare and every number, code and address has some: the patterns above are tried around them alone.
DIGITS = re.compile(r"\d+(?:(?:[ \n.\-/()\u00a0]{1,2}|[ ][-/][ ])\d+)*")
STREET_EN = "Street|Str?\\.|Road|Rd\\.?|Avenue|Ave\\.?|Lane|Ln\\.?|Drive|Close|Square|Terrace|Boulevard|Blvd\\.?|Way|Court"
STREET_ROM = r"C/|C\.|Calle|CALLE|Avda\.?|AVDA\.?|Avenida|Plaza|PLAZA|Pza\.?|Paseo|Camino|Ronda|Travesía|Via|VIA|Viale|Piazza|PIAZZA|P\.za|Corso|Vicolo|Largo|Strada|V\.le|Rua|RUA|R\.|Travessa|Tv\.|Praça|Pç\.|Estrada|Alameda|Av\."
STREET_FR = r"rue|avenue|av\.|boulevard|bd|bld|place|chemin|impasse|allée|quai|route|cours"
GAP = r"(?:[ ]{1,2}|[ ]?\n[ ]?)"
ZIP = r"(?:\d{4}-\d{3}|\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
PLACE = rf"[{U}][{L}{U}]+(?:-(?:(?:le|la|les|de|del|am|an|der|sur|do|da)-)?[{U}][{L}{U}]+)?(?:{GAP}[{U}][{L}]+)?"
TAIL = rf"(?:,?{GAP}(?:Apt\.?|Unit|Flat|Floor|\d\.?[ºª°]|piso|esc\.|int\.|scala|Apto\.?)[ ]?[\w.º]*)?(?:,?{GAP}{ZIP})?(?:,?{GAP}{PLACE})?(?:,?{GAP}{ZIP})?"
STREET_SPAN, LONG_WORD = 66, re.compile(r"\S{18}")
HOUSE_SIGNS = ("n.", "m.", "um", "úm", "no", ".o", " o", "ro")  # what a house number may follow without a space: n. núm. num nº no número
HOUSE = r"\d{1,4}(?:/?[A-Za-z](?!\w)|[ ][A-Da-d](?!\w))?(?!\w)"
# Two patterns, one that starts with a digit and one that starts with a capital: what they can start with is rare.
NUMBERED = re.compile(
    rf"\d{{1,4}}(?:(?:/?[A-Za-z](?!\w)|[ ][A-Da-d](?!\w))?,?{GAP}(?!The\b)(?:(?:Old|New|North|South|East|West|Upper|Lower|Great|Little){GAP})?(?:[{U}][\w’'-]*{GAP}){{1,2}}(?:{STREET_EN})(?!\w)"
    rf"|(?:[ ]?(?:bis|ter|[A-Da-d]))?,?{GAP}(?i:{STREET_FR}){GAP}(?:(?:de|des|du|la|le|les|l’|l'|d’)[ ]*){{0,2}}[{U}][\w’'-]*(?:[ ][{U}][\w’'-]*)?){TAIL}"
)
UNIT = re.compile(rf"(?:Unit|Flat|Apt\.?|Suite)[ ]\d+[A-Za-z]?,{GAP}$")
NAMED = re.compile(
    rf"(?:(?:{STREET_ROM})[ \n]?(?:(?:de|des|du|del|della|dei|la|le|las|los|l’|do|da|dos|das)[ ]+){{0,2}}[{U}][\w’'-]*(?:[ ][{U}][\w’'-]*)?[ ]*,?{GAP}(?:(?:n\.?[ ]?[ºo°]|nº|núm\.?|num\.?|número|numero|n\.)[ ]?)?{HOUSE}"
    rf"|(?:(?:Am|An der|In der|Auf der|Zum|Zur|Im)[ ]+)?[{U}][\w’'-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|berg|hof){GAP}{HOUSE}"
    rf"|(?:P\.?[ ]?O\.?{GAP}Box|Post(?:al)? Box|Postfach|Apartado(?:[ ]de[ ]correos)?|B\.?P\.|Boîte postale|Casella postale|C\.P\.|Caixa postal){GAP}(?:n?\.?º)?[ ]*\d+){TAIL}"
)
NAME = re.compile(
    rf"(?:(?P<title>(?:{TITLE}{GAP}){{1,2}})(?:(?:{CAP}|[{U}]\.){GAP}){{0,3}}(?:{PARTICLE}{GAP}){{0,2}}{CAP}"
    rf"|(?:(?:von|van|de|De|do|da|di|Di|d’|Del|del)[ ]+){{0,2}}{CAP},[ \n]{CAP}(?:[ ][{U}]\.)?(?!\w)"
    rf"|{CAP}(?:{GAP}[{U}]\.){{0,2}}(?:{GAP}(?:{PARTICLE}{GAP}){{0,2}}{CAP}){{1,3}})"
)
#: Two capitals that could be a name: the full pattern is tried only there.
PAIR = re.compile(rf"[{U}][^\s,]{{0,60}},?[ \n]{{1,3}}(?:(?:{PARTICLE}|[{U}]\.)[ \n]{{1,3}}){{0,3}}(?:[dDlL][’'])?[{U}]")
LEFT = re.compile(r"(?<!\w)(?:von der|von|van|de|De|do|da|di|Di|Del|del) $")
TITLED = re.compile(rf"(?<![\w@.+/’'-])(?:{TITLE}{GAP}){{1,2}}(?:(?:{CAP}|[{U}]\.){GAP}){{0,3}}(?:{PARTICLE}{GAP}){{0,2}}{CAP}")
#: Words beside a value: labels of form fields, and what numbers and capitals are called that are nobody's.
PHONE_CUE = re.compile(r"(?:tel|phone|mobil|móvil|movil|cell|fax|call|llam|appel|chiam|ligu|anruf|ruf|portable|telemó|handy)\w*", re.I)
COUNT_CUE = re.compile(r"(?:number|numéro|número|numero|nummer)", re.I)
ID_CUE = re.compile(r"\b(?:id|ids|dni|nif|nie|cif|cni|ssn|nino|identi\w*|passport\w*|pasaporte|passaporto|passaporte|passeport|reisepass\w*|fiscal\w*|steuer\w*|ausweis\w*|personalausweis\w*|sozial\w*|sécurité|social\w*|seguridad|cidadão|cartão|tax\w*|national|insurance|codice|documento|pièce|carte d\w*|carta d\w*|contribuinte)\b", re.I)
NOT_CUE = re.compile(r"\b(?:order|orders|ticket|lot|lote|lotto|charge|batch|version\w*|versão|versión|versione|release|ref\w*|room|isbn\w*|auftrag|bestellung|commande|pedido|encomenda|ordine|code|serial|invoice|rechnung|factura|facture|fattura|fatura|zimmer|artic\w*|artikel|artíc\w*|artig\w*|item|sku|build|page|section|part|chapter)\b", re.I)
ADDRESS_CUE = re.compile(r"(?:address|adresse|anschrift|indirizzo|dirección|direccion|domicil\w*|morada|endereço|residen\w*|lives?|habite|vive|wohn\w*|abita|mora|home|to|at|in|an|au|en|na|a)\W*$", re.I)
NAME_CUE = re.compile(r"(?<!\w)(?:by|from|to|with|for|of|dear|hi|hello|attn|attention|contact|signed|author|name|von|vom|an|mit|für|bei|laut|par|pour|avec|de|chez|selon|à|por|para|con|a|según|da|di|per|secondo|do|com|segundo|nome|nombre|nom|regards|saludos|cordialement|grüßen|grüße|saluti|cumprimentos)[\s:,.]*$", re.I)
NAME_AFTER = re.compile(rf"^(?:[ \n][{L}]+|\s*(?:<|\(\+?\d))")
NOT_NAME = re.compile(r"(?:project|projet|projekt|progetto|proyecto|projeto|plan|piano|plano|company|firm|firma|empresa|société|ditta|section|city|town|ciudad|cidade|ville|città|stadt|hotel|school|river|rivière|fluss|street|rue|via|calle|rua|avenue|place|platz|plaza|piazza)\W*$", re.I)
PLACE_CUE = re.compile(r"(?<!\w)(?:the|in|at|nach|aus|im|am|en|à|au|em|no|na|nel|nella|al|del|il|la|le|el|der|die|das|dem|den)\s$", re.I)
FIRM = re.compile(r"^\s*(?:&|GmbH|Ltd|S\.?A|S\.?L|SARL|AG|Inc|Co\b|Lda|S\.?r\.?l|· )", re.I)

FOLDING = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "5": "s", "@": "a", "°": "o", "†": "t", "6": "b", "8": "b", "9": "g", "c": "e", "h": "b", "i": "l", "á": "a", "à": "a", "â": "a", "ã": "a", "ä": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "l", "ì": "l", "î": "l", "ï": "l", "ó": "o", "ò": "o", "ô": "o", "õ": "o", "ö": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "e", "’": "'", "ﬁ": "fl"})


def fold(word: str) -> str:
    """A key that is equal for spellings a scan or a missing accent makes of one word."""
    return word.lower().translate(FOLDING).replace("ll", "u").replace("rn", "m").replace("vv", "w")


#: Labels of forms and letters that stand beside names and are none (fixed values).
LABELS = {fold(w) for w in "E-mail Email Mail Phone Tel Tél Mobile Mobil Móvil Telefon Telefone Telefono Teléfono Telemóvel Fax Contact Contacto Contatto Kontakt Correo Courriel Address Adresse Anschrift Indirizzo Dirección Domicilio Morada NIF NIE DNI IBAN Attn Call Regards National Passport Passeport Passaporte Passaporto Pasaporte Reisepass Ausweisnummer Tax Identity".split()}


class Words:
    """What is known about words: the lexicon's names and the words of ordinary prose."""

    def __init__(self, lexicon: list[tuple[str, str]], prose: list[str]) -> None:
        self.given, self.family = set(), set()
        for token, kind in lexicon:
            for part in re.split(r"\s+", token):
                if len(part) > 2:
                    (self.given if kind == "given" else self.family).add(fold(part))
        self.prose = {fold(w) for text in prose for w in re.findall(rf"(?<![\w])[{L}]+", text)}
        self.openers = {fold(w) for text in prose for w in re.findall(rf"(?:^|[.!?¿“„«]\s*)([{U}][{L}]+)", text)}
        self.nouns = {fold(w) for text in prose for w in re.findall(rf"[{U}{L}]+", text)} | {fold(w) for w in TITLE_WORDS}


def context(text: str, a: int, b: int) -> tuple[str, str, bool, bool]:
    before, after = text[max(0, a - 32) : a], text[b : b + 24]
    at_start = not before.strip() or before.rstrip(" *•-")[-1:] in "\n\t|"
    at_end = not after.strip(" .,;") or after.lstrip(" .,;)>")[:1] in "\n\t|"
    return before, after, at_start, at_end


def last(pattern: re.Pattern, text: str) -> float:
    """Distance of the pattern's last match from the end of ``text``; 99 without one."""
    at = -1
    for m in pattern.finditer(text):
        at = m.end()
    return float(len(text) - at) if at >= 0 else 99.0


def number_features(text: str, a: int, b: int, words: Words) -> list[float]:
    s = text[a:b]
    before, after, start, end = context(text, a, b)
    line = before.rsplit("\n\n", 1)[-1]
    groups = re.findall(r"\d+", s)
    lens = [len(g) for g in groups]
    head = re.match(r"[A-Z]*", s.lstrip("(+"))[0]
    tail = re.search(r"[A-Z]*$", s)[0]
    return [
        sum(lens), len(lens), lens[0], lens[-1], max(lens), min(lens), lens[1] if len(lens) > 1 else 0, lens[2] if len(lens) > 2 else 0,
        "+" in s, s.lstrip("(").startswith("00"), s.lstrip("(")[:1] == "0", "(" in s, " " in s, "." in s, "-" in s, "/" in s, "\n" in s,
        len(head), len(tail), sum(c.isupper() for c in s), bool(re.match(r"\d{4}-\d\d-\d\d$", s)), bool(re.match(r"\d+\.\d+$", s)), bool(re.match(r"\d{1,2}(\.\d{1,2}){3}$", s)),
        last(PHONE_CUE, line), last(COUNT_CUE, line), last(ID_CUE, line), last(NOT_CUE, line), after.lower().lstrip(" .,").startswith(("ext", "x", "dw", "poste", "int")), bool(re.match(r"\s*(€|£|%|\$)", after)), bool(re.match(rf"\s+[{L}]", after)), start, end, before.rstrip()[-1:] in ":|", "@" in after or "@" in before,
    ]


def email_features(text: str, a: int, b: int, words: Words) -> list[float]:
    s = text[a:b]
    before, after, start, end = context(text, a, b)
    sign = re.search(r"@|[(\[{<](?:at|a|arroba|chiocciola)|[ \n](?:at|arroba|chiocciola)[ \n]", s, re.I)
    local, domain = s[: sign.start()], s[sign.end() :]
    end_part = re.split(r"\W+", domain.strip())[-1]
    return [
        "@" in s, len(local.strip()), len(domain), domain.count("."), len(end_part), end_part.isalpha(), " @" in s or "@ " in s, "\n" in s, bool(re.search(r"[(\[{](?:at|a|arroba)", s, re.I)), bool(re.search(r"dot|punto|point|punkt|ponto", domain, re.I)), bool(re.search(r" (?:at|arroba) ", s, re.I)),
        bool(re.search(r"\.\s", domain)), end_part[:1].isupper() and not end_part.isupper(), fold(local.strip()) in words.nouns, fold(end_part) in words.nouns, "." in local or "_" in local or "+" in local or "-" in local, start, end, before.rstrip()[-1:] in ":<|", "://" in before or "//" in before[-8:], any(c.isdigit() for c in local),
    ]


def address_features(text: str, a: int, b: int, words: Words) -> list[float]:
    s = text[a:b]
    before, after, start, end = context(text, a, b)
    caps = re.findall(rf"[{U}][{L}{U}]+", s)
    return [
        len(s), bool(re.search(ZIP, s)), bool(re.match(r"\d", s)), len(re.findall(r"\d+", s)), bool(re.search("box|postfach|apartado|postal|B\\.?P", s, re.I)), bool(re.search(rf"(?:{STREET_EN})(?!\w)", s)), bool(re.search(rf"(?i:(?<!\w)(?:{STREET_ROM}|{STREET_FR}))(?!\w)", s)), bool(re.search("straße|strasse|str\\.|weg|platz|gasse|allee", s)),
        "," in s, len(caps), bool(ADDRESS_CUE.search(before)), bool(re.search(r"(?:address|adresse|anschrift|indirizzo|direcci|domicilio|morada|endereço)\w*\W*$", before, re.I)), bool(NOT_CUE.search(before[-16:])), bool(NOT_NAME.search(before)), start, end, sum(fold(c) in words.prose for c in caps), bool(re.search(r"\b(?:Unit|Apt|Flat|Suite|piso|º)", s)), "\n" in s,
    ]


def name_features(text: str, a: int, b: int, words: Words) -> list[float]:
    s = text[a:b]
    before, after, start, end = context(text, a, b)
    title = re.match(rf"(?:{TITLE}\s+)+", s)
    rest = s[title.end() :] if title else s
    parts = [p for p in re.findall(rf"[{U}{L}][^\s,]*", rest) if len(p) > 1 and not re.fullmatch(PARTICLE, p)]
    keys = [fold(p.strip(".,")) for p in parts] or [""]
    given = [k in words.given for k in keys]
    family = [k in words.family or any(x in words.family for x in k.split("-")) for k in keys]
    prose = [k in words.prose for k in keys]
    opener = [k in words.openers for k in keys]
    nouns = [k in words.nouns for k in keys]
    return [
        title is not None, len(parts), given[0], family[-1], given[-1], family[0], sum(given), sum(family), prose[0], prose[-1], opener[0], sum(nouns), sum(prose), "," in rest, rest.isupper(), rest.istitle(), bool(re.search(rf"\b[{U}]\.", rest)), "-" in rest, "\n" in s, bool(re.search(r"\d", s)), len(rest), min(len(k) for k in keys),
        bool(NAME_CUE.search(before)), bool(NAME_AFTER.search(after)), bool(NOT_NAME.search(before)), bool(PLACE_CUE.search(before)), bool(FIRM.search(after)), before.rstrip()[-1:] in ":|", start, end, after.lstrip()[:1] in ",.;", "@" in after or "@" in before, bool(re.match(r"\s*[,]?\s*\d", after)), bool(re.search(r"\d\W*$", before)), bool(re.search(rf"(?i:{STREET_EN}|straße|weg|platz)$", rest)), before.rstrip()[-1:] in ".!?…" or before.rstrip()[-1:] == "", bool(re.search(rf"[{L}],?\s$", before)), bool(re.search(r"[«“„‘\"]\s?$", before)), before.endswith(", "), bool(re.search(rf"(?<!\w)[{L}]{{1,4}}\s$", before)),
    ]


FEATURES = {"email": email_features, "phone": number_features, "id_number": number_features, "address": address_features, "name": name_features}


def candidates(text: str, words: Words) -> list[tuple[int, int, str]]:
    """Overlapping spans as (start, end, type); a number run is proposed as a phone and as an identity number."""
    out = []
    for m in (*SIGN.finditer(text), *SPOKEN.finditer(text)):
        before, after = LOCAL.search(text, max(0, m.start() - 65), m.start()), DOMAIN.match(text, m.end())
        if before is not None and after is not None and LAST_LABEL.search(text, after.start(), after.end()):
            out.append((before.start(), after.end(), "email"))
    last_end = 0
    for m in DIGITS.finditer(text):
        i, j = m.start(), m.end()
        before = text[i - 1] if i else "\n"
        if j - i >= 5 and not DECIMAL.fullmatch(m[0]):
            for n in NUMBER.finditer(text, max(last_end, i - 5), min(len(text), j + 8)):  # at most 5 before and 6 after the digits
                for a, b in unwrapped(text, n.start(), n.end()):
                    out += [(a, b, "phone"), (a, b, "id_number")]
                last_end = n.end()
        if before.isupper() or text[j : j + 1].isupper() or (j - i >= 5 and text[i - 2 : i - 1].isupper()):
            out += [(n.start(), n.end(), "id_number") for n in CODE.finditer(text, max(0, i - 16), min(len(text), j + 17)) if n.start() <= i < n.end()]  # a code has at most 16 signs
        inside = r"[ \n]{1,2}(?=\d)" if before.isalnum() else r"\n[ ]*(?=\d)"  # "Mayor2 12": the first digits belong to a word
        for k in (i, *(i + w.end() for w in re.finditer(inside, m[0]) if "\n" in m[0] or before.isalnum())):
            left = text[k - 1] if k else "\n"
            n = NUMBERED.match(text, k) if left in " \n\t|(>:*-•" else None
            if n is not None:
                unit = UNIT.search(text, max(0, text.rfind("\n", 0, k - 1), k - 120), k)
                out.append((unit.start() if unit else k, n.end(), "address"))
            elif k > 1 and (left in " \nº°" or text[k - 2 : k] in HOUSE_SIGNS):
                out += [(n.start(), n.end(), "address") for n in streets(text, k) if n.start() < k < n.end() and not (n.start() and text[n.start() - 1].isalnum())]
    for m in names(text):
        a, b = m.start(), m.end()
        if m["title"] is None:
            inner = TITLED.search(text, a, b)
            if inner is not None:
                out.append((inner.start(), inner.end(), "name"))
            comma = text.find(",", a, b)
            if comma > 0:  # "Regards, Ada Lovelace" as well as "Lovelace, Ada"
                after = NAME.match(text, comma + 2)
                if after is not None:
                    out.append((after.start(), after.end(), "name"))
            a, b = trim_name(text, a, b, words)
        else:
            a, b = trim_label(text, a, b)
        if b - a > 4:
            out.append((a, b, "name"))
            cut = text.find("\n", a, b)  # the line may end with the name, or in it
            if cut > 0 and " " in text[a:cut]:
                out.append((a, cut, "name"))
    return out


def streets(text: str, k: int) -> list[re.Match]:
    """Named streets whose house number may stand at ``k``. Kind, articles, name and sign before a number are at most nine
    words, which fit in ``STREET_SPAN`` characters unless one of them is long; what follows is read to its end."""
    a = max(0, k - STREET_SPAN)
    if LONG_WORD.search(text, a, k):
        a = k
        for _ in range(9):
            a = max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), 0)
    b = k + 70
    found = list(NAMED.finditer(text, a, min(len(text), b)))
    while found and b < len(text) and found[-1].end() >= b - 1:
        b += 64
        found = list(NAMED.finditer(text, a, min(len(text), b)))
    return found


def names(text: str) -> Iterator[re.Match]:
    """Matches of the name pattern, left to right."""
    at = 0
    while (pair := PAIR.search(text, at)) is not None:
        a = pair.start()
        before = text[a - 1] if a else " "
        if before in "’'" and a > 1 and text[a - 2] in "dDlL":
            a -= 2
            before = text[a - 1] if a else " "
        if before.isalnum() or before in "_@.+/-’'":
            at = pair.start() + 1
            continue
        particle = LEFT.search(text, max(0, a - 12), a)
        m = NAME.match(text, particle.start()) if particle is not None else None
        m = m or NAME.match(text, a)
        if m is None:
            at = pair.start() + 1
        else:
            yield m
            at = m.end()


def unwrapped(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A number run may be broken by one line end in running text; in columns every line stands for itself."""
    s = text[a:b]
    if "\n" in s and (s.count("\n") > 1 or "\t" in text[text.rfind("\n", 0, a) + 1 : a] or a == text.rfind("\n", 0, a) + 1):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text[a:b])]
        return [(m.start(), m.end()) for i, j in spans for m in NUMBER.finditer(text, a + i, a + j) if not DECIMAL.fullmatch(m[0])]
    return [] if DECIMAL.fullmatch(s) else [(a, b)]


def trim_label(text: str, a: int, b: int) -> tuple[int, int]:
    """Without a form label that follows a titled name."""
    m = re.search(r"[\s,]+([^\s,]+)$", text[a:b])
    return (a, a + m.start()) if m and fold(m[1].strip(".:")) in LABELS else (a, b)


def trim_name(text: str, a: int, b: int, words: Words) -> tuple[int, int]:
    """Without ordinary words at the ends that no lexicon knows as a name; (a, a) where fewer than two words remain."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\s,]+", text[a:b])]
    known = [fold(text[a + i : a + j].strip(".,")) for i, j in spans]
    plain = [k in LABELS or (k in words.nouns and k not in words.given and k not in words.family) for k in known]
    first, last_ = 0, len(spans) - 1
    while first <= last_ and plain[first]:
        first += 1
    while last_ > first and (plain[last_] or re.fullmatch(PARTICLE, known[last_])):
        last_ -= 1
    if last_ <= first:
        return a, a
    return a + spans[first][0], a + spans[last_][1]


class Finder:
    """The models and word lists; ``find`` returns selected spans of many texts at once."""

    def __init__(self, words: Words, models: dict[str, Boosted]) -> None:
        self.words, self.models = words, models
        mapping: dict[str, str] = {}
        for encoding in READ_AS:
            for c in [*range(0xA0, 0x180), *range(0x2010, 0x2040), 0x20AC, 0x2122]:
                wrong = read_wrong(chr(c), encoding)
                if len(wrong) > 1:
                    mapping.setdefault(wrong, chr(c))
        self.repair = Repair(mapping)

    def restored(self, text: str | None) -> Trace | None:
        """A garbled text as it is searched; None for one that needs no repair."""
        if not text or (text.isascii() and "&#" not in text) or self.repair(text)[2] == text:
            return None
        return self.repair.traced(text)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """The selected spans of each text as (start, end, type, probability), in order."""
        traces = [self.restored(t) for t in texts]
        plain = [t if trace is None else trace.text for t, trace in zip(texts, traces)]
        found: dict[str, list] = {t: [] for t in TYPES}
        for i, text in enumerate(plain):
            if text and not text.isspace():
                for a, b, kind in candidates(text, self.words):
                    found[kind].append((i, a, b))
        chosen: list[list] = [[] for _ in texts]
        for kind, spans in found.items():
            if not spans:
                continue
            model = self.models[kind]
            x = np.array([FEATURES[kind](plain[i], a, b, self.words) for i, a, b in spans], np.float64)
            for (i, a, b), p in zip(spans, model.probability(x)):
                if p >= model.threshold:
                    chosen[i].append((a, b, kind, float(p)))
        picked = [select(spans) for spans in chosen]
        return [spans if trace is None else [(*trace.back(a, b), kind, p) for a, b, kind, p in spans] for spans, trace in zip(picked, traces)]


def select(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans without overlap: mail addresses first (a name in one counts as the mail address alone), then the surest."""
    out: list = []
    for s in sorted(spans, key=lambda s: (s[2] != "email", s[2] != "address", -s[3], -(s[1] - s[0]), s[0])):
        at = bisect(out, s)  # chosen spans are in order and don't overlap: only the neighbours can be in the way
        if (at == 0 or out[at - 1][1] <= s[0]) and (at == len(out) or s[1] <= out[at][0]):
            out.insert(at, s)
    return out


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in sorted(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def train(lexicon: list[tuple[str, str]], prose: list[str], part: str = "all") -> bytes:
    """A pickled :class:`Finder`, fit on composed labelled lines (of a ``part`` of the labels and passages)."""
    words = Words(lexicon, prose)
    rows: dict[str, tuple[list, list]] = {t: ([], []) for t in TYPES}
    for text, truth in labelled_lines(TRAINING_LINES, lexicon, prose, part):
        for a, b, kind in candidates(text, words):
            good = any(k == kind and a < e and s < b and min(b, e) - max(a, s) >= 0.6 * (e - s) for s, e, k in truth)
            rows[kind][0].append(FEATURES[kind](text, a, b, words))
            rows[kind][1].append(good)
    models = {k: Boosted().fit(np.array(x, float), np.array(y, float)) for k, (x, y) in rows.items()}
    return pickle.dumps(Finder(words, models))


_OPEN: dict[int, Finder] = {}


def opened(blob: bytes) -> Finder:
    key = hash(blob)
    if key not in _OPEN:
        _OPEN[key] = pickle.loads(blob)
    return _OPEN[key]


_FITTED: dict[int, bytes] = {}


def trained(spark: SparkSession, sf: str) -> bytes:
    """Fit on the lexicon and on passages of certain language; once for the same rows in a driver process."""
    lexicon = collected(table(spark, sf, "name_lexicon").filter("token is not null").select("token", "token_kind"), MOST_LEXICON, "name lexicon")
    prose = table(spark, sf, "lang_samples").filter("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    rows = sorted(r["text"] for r in drawn(prose, "lang", "text", MOST_PASSAGES).select("text").collect())
    names_ = sorted(((r[0], r[1]) for r in lexicon), key=str)
    key = hash((tuple(names_), tuple(rows), TRAINING_LINES))
    if key not in _FITTED:
        _FITTED[key] = train(names_, rows)
    return _FITTED[key]


def personal_types(records: DataFrame, blob: bytes) -> DataFrame:
    """(src, rec_key, pii_type) of the types in each of ``records`` (src, rec_key, text); one scan."""
    sent = records.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = opened(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = finder.find(part.column(2).to_pylist())
                rows = sorted({(s, k, t) for s, k, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found) for *_, t, _ in spans}, key=str)
                columns = list(zip(*rows)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["src", "rec_key", "pii_type"])

    return records.select("src", "rec_key", "text").mapInArrow(run, "src string, rec_key long, pii_type string")


def redacted(records: DataFrame, blob: bytes) -> DataFrame:
    """(src, rec_key, text, n_found): every record with typed placeholders and all else as it was; one scan, no shuffle.

    A repeated row comes out as often as it came in.
    """
    sent = records.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = opened(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                given = part.column(2).to_pylist()
                found = finder.find(given)
                texts = [redact(g, f) if f else g for g, f in zip(given, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["src", "rec_key", "text", "n_found"])

    return records.select("src", "rec_key", "text").mapInArrow(run, "src string, rec_key long, text string, n_found int")


def records_of(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_results").select(F.lit("page").alias("src"), F.col("page_key").alias("rec_key"), "text")
    return pages.unionByName(table(spark, sf, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_key").alias("rec_key"), "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_types(records_of(spark, sf), trained(spark, sf)).distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(records_of(spark, sf), trained(spark, sf))
