"""Composed lines with known personal data, the labelled rows that the models of problem 1 are fit on.

Nothing here is a sentence about people: a line is a passage of certain language with a value put between two of its
words, or a value behind the label of a form field, in a list, a table cell or on a line of its own. All names, numbers
and addresses are drawn at random; half of the names are unknown to the lexicon, and lexicon words also occur as firms,
projects, streets and places, so that the lexicon alone decides nothing. Labels and passages can be parted, so that
models fit on one part are judged on wording they have not seen.
"""

from __future__ import annotations

import random
import re
import string

SYLLABLES = "al an ar bar bel ber bran car cor dan del dor el en fal fer gar gold han hol il jan kar kel lan lin lor mal mar men mor nal ner nor or pel per quin ral ren ros sal san sel sor tal tan ter tor ul val van ver vin wal wes zar".split()
LANGS = ("en", "es", "fr", "de", "pt", "it")
TITLES = {"en": ["Mr", "Mrs.", "Ms", "Dr", "Mr.", "Prof."], "es": ["Sr.", "Sra.", "D.", "D.ª", "Dra.", "Don"], "fr": ["M.", "Mme", "Mlle", "Dr", "Monsieur"], "de": ["Herr", "Frau", "Herrn", "Dr.", "Herr Dr."], "pt": ["Sr.", "Sra.", "Eng.ª", "Eng.", "Dr.ª", "Dona"], "it": ["Sig.", "Sig.ra", "Dott.", "Dott.ssa", "Ing."]}
PARTICLES = {"en": ["O’", ""], "es": ["de ", "del "], "fr": ["de ", "d’", "le "], "de": ["von ", "von der "], "pt": ["do ", "da "], "it": ["De ", "Di "]}
#: Labels of form fields, single words of everyday letters and forms; every third one can be held out of fitting.
LABELS = {
    "name": "Name Contact Attn Signed Author Customer Nombre Contacto Firmado Cliente Atención Nom Contact Signé Client Auteur Name Kontakt Kunde Gezeichnet Nome Contato Assinado Cliente Nome Contatto Firmato Autore Dear Regards Hola Saludos Bonjour Cordialement Liebe Grüße Olá Cumprimentos Gentile Saluti".split(),
    "phone": "Phone Tel Mobile Call Fax Telephone Teléfono Tel. Móvil Llame Tél. Téléphone Portable Appelez Telefon Mobil Handy Anruf Telefone Telemóvel Ligue Telefono Cellulare Chiamare Cell Ruf".split(),
    "id_number": "ID SSN Passport Identity NINO DNI NIF NIE Pasaporte CNI Passeport Fiscal Ausweis Personalausweis Steuernummer Reisepass Sozialversicherung Cidadão Contribuinte Passaporte Passaporto Documento Fiscale Identità Identidad Identité".split(),
    "address": "Address Home Lives Street Dirección Domicilio Vive Adresse Domicile Habite Anschrift Adresse Wohnt Wohnort Morada Endereço Mora Indirizzo Residenza Abita".split(),
    "email": "E-mail Email Mail Contact Correo Courriel Mél E-Mail Kontakt Correio Posta Contatto mailto".split(),
}
#: Words that titles of sections and tables are made of in business papers; ordinary words, whatever their case.
TITLE_WORDS = (
    "summary notes scope introduction overview next steps open points items results conclusion background details appendix contents status report minutes agenda price storage goods terms delivery payment safety general current situation"
    " zusammenfassung notizen umfang geltungsbereich einleitung überblick nächste schritte offene punkte ergebnisse fazit hintergrund anhang inhalt stand bericht protokoll preis lagerung waren lieferung zahlung sicherheit lage"
    " resumen notas alcance introducción próximos pasos puntos pendientes resultados conclusión anexo contenido estado informe acta precio almacenamiento mercancías condiciones entrega pago seguridad situación actual"
    " résumé remarques portée introduction aperçu prochaines étapes points ouverts résultats annexe contenu état rapport prix stockage marchandises conditions livraison paiement sécurité situation actuelle"
    " âmbito próximos passos pontos abertos pendentes conclusão conteúdo relatório ata preço armazenamento mercadorias condições pagamento segurança situação atual"
    " riepilogo note ambito prossimi passi punti aperti risultati conclusione allegato contenuto stato rapporto verbale prezzo magazzino merci condizioni consegna pagamento sicurezza situazione attuale"
).split()
#: What numbers and capitals stand for that are nobody's: order, ticket, batch, version and their like.
NUMBERED = "Order Ticket Batch Version Invoice Reference Ref Room Item Serial Article Release Build Code SKU Pedido Lote Versión Factura Referencia Artículo Commande Lot Facture Référence Salle Auftrag Charge Rechnung Zimmer Artikel Bestellung Encomenda Versão Fatura Ordine Lotto Versione Fattura Articolo Codice Part Chapter Page Section".split()
NAMED = "project plan firm company city town hotel school river proyecto empresa ciudad hotel projet société ville rivière Projekt Plan Firma Stadt Fluss projeto empresa cidade progetto ditta città piano".split()
FIRMS = ["& Co.", "GmbH", "Ltd", "S.A.", "S.L.", "AG", "Inc.", "Lda", "S.r.l.", "SARL"]
#: Forms of numbers and signs that are nobody's; n is a run of digits, U a capital, W an invented word, w the same in small letters.
NOTHING = [
    "{n3}-{n2}", "{n3}-{n2}-{n4}", "{n4}-{n4}-{n3}", "{n3}-{n3}-{n2}", "{n2}-{n3}-{n3}", "{n3}-{n3}-{n4}", "{n2}-{n4}-{n4}", "{n3} {n3} {n3}", "{n4}-{n4}-{n4}", "{n2}.{n1}.{n1}.{n1}", "{n2}.{n1}.{n2}", "{n2}/{n3}", "{n4}-{n4}", "{n4}{n4}", "{n4}{n4}{n4}", "{U}0{U}-{n3}{U}", "{U}{n2}/{U}{U}{n2}", "{U}{U}-{n4}", "{n4}.{n4}.{n2}", "978-{n1}-{n4}-{n4}-{n1}", "{U}{n4}", "{n3}", "{n4}",
]
AMOUNTS = ["£{n4}", "€{n3}", "{n4} €", "{n3}.{n2}", "{n1},{n3}", "${n2}.{n2}", "20{n2}-0{n1}-1{n1}", "1{n1}.0{n1}.20{n2}", "1{n1}:3{n1}:0{n1}", "{n2} %", "{n4}", "20{n2}"]
SIGNS = ["@{w}", "@ {w}", "{w}@", "{w} @ {n2}", "https://{w}.example/{w}?id={n4}", "[EMAIL]", "[PHONE]", "[NAME]", "a@b", "p@{w}", "{w}.{w}", "#{w}"]


class Composer:
    """Draws labelled lines, from all labels and passages, or from every third (``held_out``), or the others (``fit``)."""

    def __init__(self, lexicon: list[tuple[str, str]], prose: list[str], seed: int = 20, part: str = "all") -> None:
        self.r = random.Random(seed)
        self.given = [t for t, k in lexicon if k == "given"] or ["Anna"]
        self.family = [t for t, k in lexicon if k != "given"] or ["Muster"]
        sentences = [s for text in prose for s in re.split(r"(?<=[.!?])\s+", text) if len(s.split()) > 3] or ["It is late again today."]
        own = lambda x: [w for i, w in enumerate(x) if part == "all" or (i % 3 == 1) == (part == "held_out")]
        self.prose = own(sentences) or sentences
        self.labels = {k: own(v) for k, v in LABELS.items()}
        self.numbered, self.named = own(NUMBERED), own(NAMED)

    def digits(self, n: int) -> str:
        return str(self.r.randint(1, 9)) + "".join(self.r.choice(string.digits) for _ in range(n - 1))

    def word(self) -> str:
        return "".join(self.r.sample(SYLLABLES, self.r.choice((2, 2, 3)))).capitalize()

    def filled(self, form: str) -> str:
        one = {"{W}": self.word, "{w}": lambda: self.word().lower(), "{U}": lambda: self.r.choice(string.ascii_uppercase), **{f"{{n{i}}}": (lambda i=i: self.digits(i)) for i in range(1, 5)}}
        return re.sub(r"\{(?:n\d|[WwU])\}", lambda m: one[m[0]](), form)

    def name(self, lang: str) -> str:
        r = self.r
        known = lambda pool: (r.choice(pool) if r.random() < 0.62 else self.word())
        up = lambda w: w[:1].upper() + w[1:] if " " not in w else w
        given, family = up(known(self.given)), up(known(self.family))
        if r.random() < 0.12:
            family = r.choice(PARTICLES[lang]) + family
        if r.random() < 0.1:
            family = f"{family}-{self.word()}"
        form = r.random()
        if form < 0.45:
            out = f"{given} {family}"
        elif form < 0.53:
            out = f"{given} {r.choice(string.ascii_uppercase)}. {family}"
        elif form < 0.61:
            out = f"{given} {family} {up(known(self.family))}"
        elif form < 0.7:
            out = f"{family}, {given}"
        elif form < 0.76:
            out = f"{given} {family}".upper()
        elif form < 0.88:
            out = f"{r.choice(TITLES[lang])} {given} {family}"
        else:
            out = f"{r.choice(TITLES[lang])} {family}"
        if r.random() < 0.05:
            i = r.randrange(1, len(out))
            out = out[:i] + {"o": "0", "a": "@", "l": "1", "e": "c", "i": "!", "s": "5", "t": "†"}.get(out[i], out[i]) + out[i + 1 :]
        return out

    def phone(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            lambda: f"+44 7{d(3)} {d(6)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)} ext. {d(2)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"001 {d(3)} {d(3)} {d(4)}", lambda: f"+34 6{d(2)} {d(3)} {d(3)}", lambda: f"(+34) 9{d(2)}.{d(3)}.{d(3)}", lambda: f"0034-9{d(2)}-{d(3)}-{d(3)}", lambda: f"6{d(8)}", lambda: f"9{d(2)} {d(3)} {d(3)}",
            lambda: f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0033 6{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+49 (0)30 {d(5)} {d(3)}", lambda: f"0152 {d(8)}", lambda: f"(0221) {d(4)} {d(3)}", lambda: f"+49 {d(2)} {d(6)}", lambda: f"030/{d(7)}", lambda: f"+351 9{d(2)} {d(3)} {d(3)}", lambda: f"00351 21 {d(3)} {d(4)}", lambda: f"21 {d(4)} {d(3)}", lambda: f"9{d(2)} {d(3)} {d(3)}",
            lambda: f"+39 06 {d(4)} {d(4)}", lambda: f"+39 3{d(2)} {d(3)} {d(4)}", lambda: f"06-{d(8)}", lambda: f"06 {d(8)}", lambda: f"0{d(2)}/{d(6)}", lambda: f"+{d(2)}{d(9)}",
        ])()

    def identity(self) -> str:
        r, d, u = self.r, self.digits, lambda: self.r.choice(string.ascii_uppercase)
        return r.choice([
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{u()}{u()} {d(2)} {d(2)} {d(2)} {u()}", lambda: f"{u()}{u()}{d(6)}{u()}", lambda: f"00{d(6)}{u()}", lambda: f"00{d(6)}-{u()}", lambda: f"{d(2)}.{d(3)}.{d(3)}-{u()}", lambda: f"X-{d(7)}-{u()}", lambda: f"X{d(7)}{u()}", lambda: f"{u()}{d(8)}",
            lambda: f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{r.choice('12')}{d(14)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: d(11), lambda: f"0{d(2)} {d(3)} {d(3)}", lambda: f"0{d(8)}", lambda: f"{u()}{u()}{d(5)}{u()}{u()}", lambda: "".join(u() for _ in range(6)) + f"{d(2)}{u()}{d(2)}{u()}{d(3)}{u()}", lambda: f"{d(8)} {d(1)} {u()}{u()}{d(1)}", lambda: f"{u()}{u()}{d(7)}", lambda: f"{u()}{d(2)}{u()}{d(5)}",
        ])()

    def street(self, lang: str) -> str:
        r, d = self.r, self.digits
        w = self.word() if r.random() < 0.8 else r.choice(self.family).split(" ")[-1].capitalize()
        n = str(r.randint(1, 140)) + r.choice(["", "", "", "a", "B"])
        place = r.choice([self.word(), f"{self.word()} {self.word()}", f"{self.word()}-le-{self.word()}"])
        code = "00" + d(3)
        body = {
            "en": [f"{n} {w} Street", f"{n} Old {w} Lane", f"Unit {d(1)}, {n} {w} Avenue", f"{n} {w} Rd., Apt {d(1)}", f"P.O. Box {d(r.choice((2, 3, 4)))}", f"PO Box {d(3)}", f"{n} {w} Road"],
            "es": [f"Calle de {w}, {n}", f"C/ {w} nº {n}", f"Plaza {w} {n}", f"Avda. {w}, {n}, 3.º B", f"Calle {w} {n}", f"Paseo {w}, {n}", f"Apartado {d(3)}"],
            "fr": [f"{n}, rue des {w}s", f"{n} bis avenue {w}", f"{n} bd {w}", f"{n}, rue {w}", f"{n} place {w}", f"B.P. {d(3)}"],
            "de": [f"{w}straße {n}", f"{w}weg {n}", f"Am {w}platz {n}", f"{w}str. {n}", f"{w}gasse {n}", f"Postfach {d(r.choice((2, 3, 4)))}"],
            "pt": [f"Rua do {w}, {n}", f"Travessa {w} n.º {n}", f"Av. {w}, {n}", f"Rua {w} {n}", f"Largo {w}, {n}", f"Caixa postal {d(3)}"],
            "it": [f"Via {w} {n}", f"Piazza {w} {n}", f"Corso {w}, {n}", f"Viale {w} {n}", f"Casella postale {d(3)}"],
        }[lang]
        out = r.choice(body)
        tail = r.random()
        return out + (f", {code} {place}" if tail < 0.35 else f", {place}" if tail < 0.7 else f" {place} {code}" if tail < 0.78 else f"\n{code} {place}" if tail < 0.88 else "")

    def email(self) -> str:
        r = self.r
        a, b = (self.word() if r.random() < 0.6 else r.choice(self.given + self.family).split(" ")[-1] for _ in range(2))
        local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{a}_{self.digits(2)}", f"{a}+{b[:3]}", "info", f"{a}-{b}", f"{a}{self.digits(1)}"]).lower()
        host = ".".join(self.word().lower() for _ in range(r.choice((1, 1, 2)))) + r.choice([".com", ".org", ".example", ".test", ".example.net", "-desk.example.com", ".invalid", ".de"])
        form = r.random()
        if form < 0.6:
            out = f"{local}@{host}"
        elif form < 0.72:
            out = f"{local} @ {host}"
        elif form < 0.82:
            out = f"{local}[at]{host}" if r.random() < 0.5 else f"{local} (at) {host}"
        elif form < 0.92:
            out = f"{local} (at) {host.replace('.', ' (dot) ')}" if r.random() < 0.6 else f"{local} at {host.replace('.', ' dot ')}"
        else:
            out = f"{local}@{host}".upper()
        return out

    def heading(self) -> str:
        """Ordinary or invented words set like a title or a name, perhaps with a code or number."""
        r = self.r
        words = [r.choice(re.findall(r"[^\W\d_]{2,}", r.choice(self.prose)) or ["x"]) if r.random() < 0.6 else self.word() for _ in range(r.choice((2, 2, 3)))]
        upper = r.random() < 0.5
        often = r.choice((0.2, 0.9))
        text = " ".join(w.upper() if upper else w.capitalize() if i == 0 or r.random() < often else w.lower() for i, w in enumerate(words))
        return text + r.choice(["", "", f"    {r.choice('ABCXZ')}{r.choice('ABCXZ')}-{self.digits(4)}", f"   {self.digits(2)}", "\tno\tsum", "."])

    def misread(self, text: str) -> str:
        """A sentence in which a scan made signs of letters."""
        signs = {"a": "@", "o": "0", "i": "!", "l": "1", "s": "5"}
        return "".join(signs[c] if c in signs and self.r.random() < 0.12 else c for c in text)

    def inside(self, value: str) -> tuple[str, int]:
        """A passage with a value between two of its words, and where it stands: mostly behind a short word, or in place
        of the first words, or at the end."""
        r, words = self.r, self.r.choice(self.prose).split()
        short = [i for i in range(1, len(words)) if len(words[i - 1]) <= 4 and words[i - 1].islower()]
        pick = r.random()
        if pick < 0.5 and short:
            at = r.choice(short)
            before, after = words[:at], words[at + r.choice((0, 0, 1, 2)) :]
        elif pick < 0.75:
            before, after = [], [w for w in words[r.choice((1, 2, 2, 3)) :]]
        elif pick < 0.9:
            before, after = words[: r.randint(2, len(words) - 1)], []
        else:
            at = r.randint(1, len(words) - 1)
            before, after = words[:at], words[at:]
        head = " ".join(before) + " " if before else ""
        return head + value + (" " + " ".join(after) if after else "."), len(head)

    def around(self, value: str, label: str) -> tuple[str, int]:
        """A value behind a label, in a passage, in a cell, list or line of its own, and where it stands."""
        r, form = self.r, self.r.random()
        if form < 0.34:
            mark = r.choice([" ", ": ", ": ", " : ", " no. ", " n° ", ". ", ", ", "\n", "\t"])
            shown = label if r.random() < 0.7 else label.lower()
            if r.random() < 0.3:
                text, at = self.inside(f"{shown.lower()}{mark}{value}")
                return text, at + len(shown) + len(mark)
            tail = r.choice(["", "", ".", f" {r.choice(self.prose).split(' ', 1)[1]}"])
            return f"{shown}{mark}{value}{tail}", len(shown) + len(mark)
        if form < 0.7:
            return self.inside(value)
        head, tail = r.choice([("", ""), ("", ""), ("| ", f" | {self.digits(2)} |"), ("", f"\t{self.digits(2)}"), (f"{self.word().lower()}\tn\n", f"\t{self.digits(1)}"), ("", f"\tabc\t{self.digits(1)}"), ("- ", ""), ("<", ">"), ("(", ")"), ("", f"\n{self.word()}"), (f"{self.word().lower()}, ", "")])
        return head + value + tail, len(head)

    def nothing(self) -> str:
        """A line with numbers, signs or capitals and nobody in it."""
        r, pick = self.r, self.r.random()
        if pick < 0.18:
            return self.heading()
        if pick < 0.28:
            return self.misread(r.choice(self.prose))
        if pick < 0.62:
            number, label = self.filled(r.choice(NOTHING)), r.choice(self.numbered)
            label = label if r.random() < 0.7 else label.lower()
            shown = f"{label}{r.choice([' ', ' ', ': ', ' no. ', ' n.º ', ' n.º' + chr(10), chr(10)])}{number}"
            shown = self.misread(shown) if r.random() < 0.1 else shown
            if r.random() < 0.3:
                shown += f" {r.choice(r.choice(self.prose).split()).lower()} {self.filled(r.choice(NOTHING))}"
            return self.inside(shown)[0] if r.random() < 0.6 else f"{shown}."
        if pick < 0.73:
            return self.inside(self.filled(r.choice(AMOUNTS)))[0] if r.random() < 0.7 else f"{self.word().lower()}\t{self.filled(r.choice(AMOUNTS))}\t{self.filled(r.choice(AMOUNTS))}"
        if pick < 0.79:
            return self.inside(self.filled(r.choice(SIGNS)))[0]
        some = lambda: self.word() if r.random() < 0.6 else r.choice(r.choice((self.given, self.family))).capitalize()
        thing = r.choice([*[f"{r.choice(self.named)} {some()} {some()}"] * 3, f"{r.choice(self.named)} {some()}", f"{some()} {r.choice(FIRMS)}", f"{some()} {some()} {r.choice(FIRMS)}", f"{some()} & {some()}", f"“{some()} {some()}”", f"{some()}, {some()}, {some()}", f"{some()} Street", f"{some()} Hill", f"San {some()}", f"{some()} · {self.heading()}", some()])
        return self.inside(thing)[0] if r.random() < 0.7 else thing + r.choice(["", ".", f" {self.digits(1)}"])

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, lang = self.r, self.r.choice(LANGS)
        kind = r.choice(["name", "name", "phone", "id_number", "address", "email", None, None, None])
        if kind is None:
            return self.nothing(), []
        value = {"name": lambda: self.name(lang), "phone": self.phone, "id_number": self.identity, "address": lambda: self.street(lang), "email": self.email}[kind]()
        text, at = self.around(value, r.choice(self.labels[kind]))
        return text, [(at, at + len(value), kind)]


def labelled_lines(n: int, lexicon: list[tuple[str, str]], prose: list[str], part: str = "all") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` short texts of one to four lines with the spans of the personal data in them."""
    composer = Composer(lexicon, prose, part=part)
    out = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(composer.r.choice((1, 2, 3, 4))):
            part, spans = (composer.r.choice(composer.prose), []) if composer.r.random() < 0.3 else composer.line()
            truth += [(len(text) + a, len(text) + b, k) for a, b, k in spans]
            text += part + composer.r.choice((" ", " ", "\n", "\n\n", "\n- ", "\n* "))
        out.append((text, truth))
    return out
