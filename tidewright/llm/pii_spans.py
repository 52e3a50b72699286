"""Candidate spans of personal information: high recall, overlapping, without any statistics but a set of name words.

A search never depends on what was sampled: capitalised names, mail addresses,
numbers and street addresses are proposed by their format alone. A name in
lower case is proposed after a word that introduces persons, and where one of
its words is among the given name words (which come from all documents).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container, Iterator
from functools import lru_cache

KINDS = ("name", "email", "phone", "id_number", "street_address")

# --- cues: fixed values, words that stand before, after or inside spans in English, Spanish, German and Filipino ----

CUES = {
    "title": "mr mrs ms miss mister dr doctor prof professor sir madam captain capt herr herrn frau señor señora señorita sr sra srta don doña doctora ginoong ginang gng bb aling mang kapitan kap",
    "marker": "si ni kay sina nina kina",
    "agent": "by von durch por vom per nina with mit con und and y at bei para for für an to a from de",
    "speech": "call called calling ask asked tell told phone ring notify remind thank thanks dear hello regards contact meet met anrufen bitte fragen frag rufen sprechen llamar llame avisar avise preguntar pregunte contactar gracias hola estimado estimada tawagan tawag tanungin kausapin sabihan salamat signed unterzeichnet firmado lagda according laut según ayon informó says said sagt meldete dijo",
    "role": "visitor visitors reviewer inspector operator buyer seller supplier owner holder driver guard worker foreman crew contact name names person attn reviewed inspected besucher besucherin gast prüfer prüferin käufer inhaber inhaberin fahrer name kontakt ansprechpartner geprüft empfänger visitante revisor revisora comprador titular dueño conductor nombre contacto revisado destinatario bisita tagasuri mamimili may-ari pangalan tsuper sinuri tagapamahala recipient sender",
    "phone": "phone telephone tel tlf mobile cell cellphone fax call calls ring text dial whatsapp sms hotline telefon handy mobil rufnummer anrufen rufen durchwahl teléfono telefono móvil movil celular llamar llame fijo telepono tawag tawagan itext selpon",
    "id": "passport ssn id idno id_no social security identity identification national insurance nino dni nie nif nif/nie tin sss gsis philsys umid seaman seamans seafarer seafarers discharge sirb visa licence license ausweis ausweisnummer ausweisnr personalausweis personalausweisnummer reisepass reisepassnummer passnummer sozialversicherungsnummer seefahrtsbuch seemannsbuch identität pasaporte cédula cedula identidad documento seguridad libreta marítima marino pagkakakilanlan pasaporte seguro",
    "mail": "mail email e-mail mails correo write wrote writes schreiben schreib schicken escribir escriba escribe sumulat sulatan cc bcc from reply rückfragen questions dudas inbox adresse",
    "address": "lives live living address addr resident residence residing home household street deliver delivered delivery ship shipped send sent return stored kept pick wohnt wohnhaft wohnen anschrift adresse lieferung liefern liefert gelagert liegt vive viven domicilio dirección direccion entrega entregar envío enviar envíe guardado recoger nakatira tirahan tahanan direksyon ihatid dalhin ipadala nakaimbak parcel paket paquete",
    "thing": "lot lote lots batch charge pallet palette palé pallets crate kiste caja kahon specimen specimens probe muestra sampol sample serial serials sn seriennummer serie ticket tickets tray bandeja bandeha device gerät dispositivo aparato sensor scale waage camera kamera cámara meter zähler reading readings messwert lectura rack regal shelf export file datei archivo order bestellung pedido invoice rechnung factura frame frames track spur pista session image images bild bilder foto imagen larawan checkpoint container barcode sku version model modell modelo label part artikel asset tag meter numbered counter run job build",
    "vessel": "mv fv mb fb ms ss rv f/v m/v f/b m/b vessel boat ship trawler launch barco buque lancha pesquero schiff kutter boot barko bangka",
    "place": "landing quay harbour harbor port pier dock docks wharf market bay island point slip lane row cove beach bridge yard station hall town city village hafen markt kai insel bucht puerto muelle lonja isla bahía playa pantalan palengke barangay brgy pulo look",
    "firm": "ltd inc corp llc gmbh ag sl sa co foods fisheries trading seafood company cooperative fisch handel pesquera hermanos bank school university universität",
    "plain": "first second third last next final daily weekly monthly yearly old new good both all no every each this that these those the our my his her their its what when where why how if then also only please note see first-class january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday der die das dem den des ein eine einen einem kein keine alle jede jeder erste erster erstes zweite zweiter zweites dritte dritter dritte letzte letzter letztes nächste nächster neue neuer alte alter gute guter ganze unser unsere mein ihre januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag el la los las un una este esta estos primer primera segundo segunda tercero tercera último última próximo nuevo nueva todo todos cada nuestro enero febrero marzo abril mayo junio julio septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo ang mga isang unang una ikalawang ikalawa ikatlong huling bagong lahat bawat ating lunes enero hunyo hulyo",
    "unit": "kg g mg mm cm m hours hour stunden horas oras pieces piezas piraso stück fish fische degrees grad grados percent euro eur usd php minutes minuten minutos minuto ml litres",
}
CUE_NAMES = tuple(CUES)
CUE_OF: dict[str, int] = {}
for _i, _words in enumerate(CUES.values()):
    for _w in _words.split():
        CUE_OF[_w] = CUE_OF.get(_w, 0) | 1 << _i
PERSONAL = sum(1 << CUE_NAMES.index(c) for c in ("title", "marker", "role"))

# --- names ------------------------------------------------------------------------------------------------

MARK = "\u0300-\u036f"  # combining accents belong to their letters


def _ranges(test) -> str:
    """The characters that meet a test, as ranges of a character class."""
    out, start = [], None
    for c in range(0x10000):  # planes beyond have no names; they would slow every search
        if test(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(c - 1))}" if c - 1 > start else ""))
            start = None
    return "".join(out)


_UPPER = _ranges(lambda c: unicodedata.category(c) in ("Lu", "Lt"))
_LETTER = rf"(?:[^\W\d_][{MARK}]*)"
WORD = rf"{_LETTER}+(?:['’\-]{_LETTER}+)*"
_CAPITAL = rf"[{_UPPER}][{MARK}]*{_LETTER}*(?:['’\-]{_LETTER}+)*"
_INITIALS = rf"[{_UPPER}][{MARK}]*\.(?:[ \u00a0]?[{_UPPER}][{MARK}]*\.){{0,3}}"
_SPACE = "[ \u00a0\u2009\u202f]"
# Small words inside family names.
_SMALL = r"(?:(?:de la|de los|de las|del|de|dela|da|dos|di|van der|van den|van|von der|von|zu|ter|ten|bin|al|el|y) )"
word = re.compile(WORD)
free_word = re.compile(rf"(?<![\w@.+\-{MARK}]){WORD}(?![\w@\-{MARK}]|\.\w)")
_END = rf"(?![\w@{MARK}])"
#: Two words, or initials and a word; then a word, a comma and the rest. The first letter is consumed, for a quick search.
_REST = rf"[{MARK}]*{_LETTER}*(?:['’\-]{_LETTER}+)*"
_capitalised = re.compile(
    rf"[{_UPPER}](?<![\w@./+\-'’{MARK}].)(?=((?:[{MARK}]*\.(?:[ \u00a0]?[{_UPPER}][{MARK}]*\.){{0,3}}{_SPACE}?{_SMALL}?{_CAPITAL}|{_REST}(?:{_SPACE}[{_UPPER}][{MARK}]*\.){{0,3}}{_SPACE}{_SMALL}?{_CAPITAL}){_END}))",
    re.S,
)
_inverted = re.compile(rf"[{_UPPER}](?<![\w@./+\-'’{MARK}].){_REST},{_SPACE}(?:{_INITIALS}(?!\w)|{_CAPITAL}(?:{_SPACE}[{_UPPER}][{MARK}]*\.(?!\w))*{_END})", re.S)
_third = re.compile(rf"{_SPACE}{_SMALL}?{_CAPITAL}{_END}")
_small_name = re.compile(rf"(?:{WORD}(?:{_SPACE}{_LETTER}\.){{0,3}}{_SPACE}{WORD}|{WORD},{_SPACE}{WORD}|{_LETTER}\.(?:{_SPACE}?{_LETTER}\.){{0,3}}{_SPACE}?{WORD}){_END}")
_SPACES = (" ", "\u00a0", "\u2009", "\u202f")
_run_of_letters = re.compile(rf"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_PERSONAL_WORDS = frozenset(w for w, bits in CUE_OF.items() if bits & PERSONAL)


@lru_cache(4096)
def _behind(cue: str) -> re.Pattern:
    """Places in lower case right behind a cue, as it is written."""
    return re.compile(rf"(?<!\w){re.escape(cue)}(?:\.? |: ?|=)(?=[^\W\d_])")


def names(text: str, known: Container[str]) -> Iterator[tuple[int, int]]:
    for m in _capitalised.finditer(text):
        a, b = m.start(), m.end(1)
        yield a, b
        if text[b - 2 : b] in ("'s", "’s"):
            yield a, b - 2
        if text[b : b + 1] in _SPACES and (more := _third.match(text, b)):
            yield a, more.end()
            if last := _third.match(text, more.end()):
                yield a, last.end()
    for m in _inverted.finditer(text) if ", " in text else ():
        a, b = m.span()
        yield a, b
        if (short := m.group().rfind(" ")) > m.group().find(",") + 1:
            yield a, a + short
    starts: set[int] = set()
    words = set(_run_of_letters.findall(text))
    for cue in words:
        if cue in _PERSONAL_WORDS or cue.lower() in _PERSONAL_WORDS:
            starts.update(m.end() for m in _behind(cue).finditer(text) if text[m.end()].islower())
    if known and any(w in known for w in words if w[0].islower()):
        places = [(m.start(), m.end()) for m in word.finditer(text)]
        for i, (a, b) in enumerate(places):
            if text[a].islower() and b - a > 1 and text[a:b] in known:
                starts.update(places[j][0] for j in range(max(0, i - 3), i + 1) if a - places[j][1] <= 6)
    for a in sorted(starts):
        if (m := _small_name.match(text, a)) and not (a and (text[a - 1].isalnum() or text[a - 1] in "_@./+-'’")):
            yield a, m.end()
            if (short := m.group().rfind(" ")) > 0 and len(word.findall(m.group())) > 2:
                yield a, a + short


# --- mail addresses ----------------------------------------------------------------------------------------

_anchor = re.compile(r"@| ?[\[(] ?[Aa][Tt] ?[\])] ?| [Aa][Tt] (?=[\w\-]+(?:\.| dot | ?[\[(]))")
_user = re.compile(r"(?<![\w.+\-])[\w+\-]+(?:\.[\w+\-]+)*$")
_dot = r"(?:\.|\ ?[\[(]\ ?dot\ ?[\])]\ ?|\ dot\ )"
_host = re.compile(rf"[\w\-]+(?:{_dot}[\w\-]+)*{_dot}[^\W\d_]{{2,}}(?![\w@])", re.I)
dots = re.compile(_dot, re.I)


def emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _anchor.finditer(text):
        user = _user.search(text[max(0, m.start() - 80) : m.start()])
        host = _host.match(text, m.end())
        if not user or not host:
            continue
        a, b = max(0, m.start() - 80) + user.start(), host.end()
        yield a, b
        # shorter readings: without the last label, without what precedes the first dot of the user
        labels = list(dots.finditer(text, m.end(), b))
        if len(labels) > 1:
            yield a, labels[-1].start()
        if m.group() == "@" and text[a].isalpha() and (front := user.group().find(".") + 1):
            yield a + front, b


# --- numbers -----------------------------------------------------------------------------------------------

_DASH = "\\-\u2010\u2011\u2012\u2013－"  # inside a character class
_run = re.compile(rf"(?<![\w.,/\-@#])[+＋(（]{{0,2}}\d{{1,14}}(?:[)）]?(?:[.{_DASH}]|{_SPACE}?/?{_SPACE}?)[(（]?\d{{1,14}})*")
_group = re.compile(r"[+＋(（]{0,2}\d+")
_day = re.compile(r"(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4})(?: \d{1,2})?$")
_code = re.compile(rf"(?<![\w.,/\-@#])(?:[A-Z]{{1,3}}|\d+[A-Z]?|[A-Z]{{1,3}}\d[A-Z\d]*)(?:(?:[.{_DASH}]|{_SPACE})(?:[A-Z]{{1,3}}(?![a-z'’])|\d+[A-Z]?(?!\w)|[A-Z]{{1,3}}\d[A-Z\d]*))*(?!\w)")
_chunk = re.compile(r"\S+")
_digit = re.compile(r"\d")
_seven = re.compile(rf"\d(?:[\d().{_DASH}/（）+A-Z]|{_SPACE}){{4,}}[\dA-Z]")


def digits_of(span: str) -> int:
    return len(_digit.findall(span))


def is_date(span: str) -> bool:
    """Whether the span is a date, also one with a misplaced or missing separator."""
    if _day.match(span):
        return True
    digits = re.sub(r"\D", "", span)
    if len(digits) not in (7, 8) or not re.fullmatch(r"[\d.\-]+", span) or span == digits:
        return False
    return bool(re.match(r"(?:19|20)\d\d[01]", digits) or re.match(r"[0-3]\d?[01]\d?(?:19|20)\d\d$", digits))


#: Two decimal fractions, one behind the other; the second is only looked at, as it may begin another pair.
_pair = re.compile(r"(?<![\w.])[+\-−]?(\d{1,3}\.\d{3,12})(?: ?°)?(?: ?[NSEWO])? ?[,;/] ?(?=[+\-−]?(\d{1,3}\.\d{3,12})(?!\w|[.\-]\d))")
_PAIR = 48  # characters that a pair has at most


def is_position(text: str, a: int, b: int) -> bool:
    """Whether the span meets a latitude and a longitude, in either order."""
    for m in _pair.finditer(text, max(0, a - _PAIR), b + _PAIR):
        one, two = m.groups()
        if m.start(1) < b and m.end(2) > a and max(float(one), float(two)) <= 180 and min(float(one), float(two)) <= 90 and not any(v[0] == "0" and v[1] != "." for v in (one, two)):
            return True
    return False


def numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _run.finditer(text):
        if m.end() - m.start() < 7 or digits_of(m.group()) < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _group.finditer(m.group())]
        starts = [0] + [i for i in range(1, len(groups)) if text[groups[i][0]] in "+＋(（" or text[groups[i][0] - 1].isspace()]
        for i in starts:
            digits = 0
            for j in range(i, len(groups)):
                digits += digits_of(text[groups[j][0] : groups[j][1]])
                end = groups[j][1]
                if digits > 15:
                    break
                start = groups[i][0]
                while text[start] in "(（" and len(re.findall("[(（]", text[start:end])) > len(re.findall("[)）]", text[start:end])):
                    start += 1
                inside = end < m.end() and not text[end].isspace()
                if digits >= 7 and not inside and not (end < len(text) and (text[end].isalnum() or text[end] == "_")) and not is_date(text[start:end]):
                    yield start, end


def codes(text: str) -> Iterator[tuple[int, int]]:
    for m in _code.finditer(text):
        if m.end() - m.start() < 7 or digits_of(m.group()) < 5:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _chunk.finditer(m.group())]
        for i in range(len(groups)):
            for j in range(i, min(i + 6, len(groups))):
                a, b = groups[i][0], groups[j][1]
                piece = text[a:b]
                if b - a > 24:
                    break
                if b - a >= 7 and digits_of(piece) >= 5 and not is_date(piece):
                    yield a, b


# --- street addresses ----------------------------------------------------------------------------------------

# Words that end or begin names of streets, and parts of a building or block.
_STREET = r"(?:street|road|avenue|lane|way|wharf|row|quay|drive|court|close|terrace|square|alley|walk|hill|pier|parade|crescent|place|boulevard|mews|gardens)\b|(?:st|rd|ave|ln|dr|ct|sq|blvd)\b\.?"
_STRASSE = "straße|strasse|str|gasse|weg|ufer|platz|allee|damm|kai|steig|ring|hof|markt"
_CALLE = r"calle|c/|avda\.?|avenida|av\.|paseo|p\.º|plaza|pza\.?|camino|ronda|travesía|callejón|carretera"
_KALYE = r"kalye|calle|daang|abenida|kalsada"
_UNIT = r"(?:flat|unit|floor|house|apt\.?|apartment|suite|room|haus|hs\.|whg\.?|wohnung|etage|stock|block|blk\.?|lot|purok|piso|planta|puerta|bldg\.?|unit no\.)"
_NUMBER = r"\d{1,4}(?:\ ?(?-i:[A-Z])|[a-z])?(?!\w)"
_CAP = r"[^\W\d_][^\W\d_'’\-]*"
#: Behind a full stop: the end, or a capital. The stop is the sentence's, not that of "St." or "Ave.".
_goes_on = re.compile(rf"\s*(?:$|[{_UPPER}])")
_SPREAD = 70  # characters before and after the anchor that a pattern may use
#: (anchor in lower case, pattern): a pattern is searched only around its anchor.
_STREETS = [
    (re.compile(rf" (?:{_STREET})"), re.compile(rf"(?<![\w/.\-])(?:{_UNIT}\ \d+[a-z]?,\ )*{_NUMBER},?\ (?:{_CAP}\ ){{1,3}}?(?:{_STREET})(?:,\ {_UNIT}\ \d+[a-z]?)*", re.I)),
    (re.compile(rf" (?:{_STREET})"), re.compile(rf"(?<![\w/.\-])(?:{_UNIT}\ \d+[a-z]?,?\ )+(?:{_CAP}\ ){{1,3}}?(?:{_STREET})(?:,\ {_UNIT}\ \d+[a-z]?)*", re.I)),
    (re.compile(rf"\b(?:{_KALYE}) "), re.compile(rf"(?<![\w/.\-])(?:{_UNIT}\ \d+[a-z]?,\ )*\d{{1,4}}[a-zA-Z]?,?\ (?:{_KALYE})\ {_CAP}(?:\ (?-i:[A-Z])[^\W\d_]+)?(?:,\ {_UNIT}\ \d+[a-z]?)*", re.I)),
    (re.compile(rf"(?:{_STRASSE})\b\.? \d"), re.compile(rf"(?<![\w/.\-])(?:(?:am|an\ der|an\ den|auf\ dem|zum|zur|im)\ )?(?:{_CAP}(?:\ |-)){{0,2}}?(?:{_CAP}?)?(?:{_STRASSE})\b\.?\ {_NUMBER}(?:,\ {_UNIT}\ \d+[a-z]?)*", re.I)),
    (re.compile(rf"(?<![\w.\-])(?:{_CALLE}) ?\w"), re.compile(rf"(?<![\w.\-])(?:{_CALLE})\ ?(?:{_CAP}\ ?){{1,5}}?,?\ ?(?:n\.?\ ?º\ ?|n[úu]m\.\ ?|no\.\ ?)?{_NUMBER}(?:,\ \d{{1,2}}\.?\ ?º(?:\ [A-Za-z]\b)?)?(?:,\ {_UNIT}\ \d*\w?)*", re.I)),
]


def addresses(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if len(low) != len(text):  # a letter of another length in lower case would shift places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for anchor, pattern in _STREETS:
        done = 0
        for found in anchor.finditer(low):
            at = max(done, found.start() - _SPREAD)
            stop = min(len(text), found.end() + _SPREAD)
            while (m := pattern.search(text, at, stop)) and m.start() <= found.end():
                body = m.group()
                final = body.endswith(".") and _goes_on.match(text, m.end()) is not None
                if not final:
                    yield m.span()
                else:
                    yield m.start(), m.end() - 1
                if (comma := body.rfind(", ")) > 0:
                    yield m.start(), m.start() + comma
                if pattern is _STREETS[3][1]:  # a sentence's words may stand before the street
                    for w in re.finditer(r"(?<=\ )\w", body):
                        if any(c.isalpha() for c in body[w.start() :].split(" ")[0]) and w.start() < len(body) - 4:
                            yield m.start() + w.start(), m.end()
                at = m.start() + max(1, body.find(" ") + 1)
            done = max(done, min(at, found.start()))


def candidates(text: str, known: Container[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span that may be personal information."""
    out = [("name", *s) for s in names(text, known)]
    out += [("email", *s) for s in emails(text)]
    if _seven.search(text):
        out += [("phone", *s) for s in numbers(text)]
        out += [("id_number", *s) for s in codes(text)]
    out += [("street_address", *s) for s in addresses(text)]
    return list(dict.fromkeys(out))

