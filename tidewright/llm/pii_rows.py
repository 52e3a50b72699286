"""Generated labelled rows: sentences with invented personal data and with things that only look like it.

FORMS are phrasings of notes, mails and forms in English, Spanish, German and
Filipino. ``(a|b)`` is a choice, ``{N}`` a name, ``{E}`` a mail address, ``{P}``
a phone number, ``{I}`` an identity number, ``{A}`` a street address; the other
slots are no personal data: ``{T}`` a thing's number, ``{V}`` a vessel, ``{L}`` a
place, ``{F}`` a firm, ``{D}`` a date, ``{C}`` a clock time, ``{K}`` a quantity, ``{G}`` a
decimal fraction.
All values are made of syllables and formats, so none is taken from a table.
"""

from __future__ import annotations

import random
import re

#: Rows that the classifier is fitted on; a parameter of pii.fit.
ROWS = 9000

FORMS = (
    # English, names
    "(Yesterday |Today |)(I spoke|we spoke|she talked|he talked) (to|with) {N} about the (order|delay|sample|invoice).", "{N} (signed|checked|approved|rejected|counted|opened|closed|cleaned|repaired) the (form|boxes|trays|freezer|gate|sheet)( at {C}| on {D}|).",
    "(Checked|Counted|Signed|Approved|Weighed|Written|Sent|Packed) by {N}( on {D}|, {D}| at {C}|.|;)", "(Dear|Hello|Hi|Dear Mr|Dear Ms) {N},", "(Best regards|Kind regards|Thanks|Yours),? {N}", "(Inspector|Supervisor|Driver|Foreman|Customer|Applicant|Patient|Trainee|Clerk): {N}(;|,|.| |)", "(name|owner|sender|signed|employee|client)={N}(;|,|&|)", '"(name|owner|author|signed_by|customer)": "{N}"',
    "(Mr|Mrs|Ms|Dr|Prof)\\. {N} (left|arrived|phoned|objected|agreed)( at {C}|).", "(Mr|Mrs|Ms|Dr) {N} and (Mr|Mrs|Ms|Dr) {N} (agree|argued|met|left early).", "(Please ask|Ask|Tell|Please remind|Remind|Thank) {N} (to|whether|that) (come|the door is shut|it was late|bring the keys).", "(As|What) {N} (said|wrote|noted), the (scale|door|list) (is|was) (fine|broken|late).", "(For|From|To|Attn|Re): {N}", "{N} | {P} | {E}", "{N}, {P}", "{N} <{E}>", "{N} ({E})", "{N} ({P}) (will come|is on call|has the keys).", "- {N}, {K}, shelf 3", "{N}: {K}", "{N}\t{K}\t{D}",
    "The (keys|papers|gloves) belong to {N}.", "{N} and {N} (shared|swapped) the (night shift|early shift).", "(Shift lead|Deputy|Witness|Present): {N}, {N}(, {N}|)", "{N}'s (locker|report|shift) (was|is) (open|late|fine).", "Per {N}, (the|all) (tests|labels|doors) were (done|checked).", "Handed (over |)to {N} (at {C}|on {D}|this morning).",
    "(Our|The) (new |)(cook|buyer|vet|auditor|guest) {N} (starts|arrives|visits) on {D}.", "We owe {N} (a reply|two crates|an answer).", "{N} moved to {A} (last year|in spring).", "{N} of {F} (called|wrote|visited)( us|).",
    # English, mails and phones
    "(Mail|Email|E-mail|Write to|Send it to|Reply to|Forward to|Ask) {E}( please|, thanks|.| or ring {P}.)", "(Questions|Complaints|Orders)( go|) to {E}(,| and) {E}.", "(email|mail|contact|reply-to)(=|: |:){E}(;| |)", '"(email|mail|from|to)": "{E}"', "(cc|bcc|From|To|Reply-To): {E}(; {E}|, {E}|)", "{E} wrote: (the|our) (list|box) is ready", "<{E}>", "(Phone|Tel|Tel\\.|Mobile|Cell|Fax|Telephone|Ph)(:|) {P}(, ext\\. 12| ext 4|.|;|,| until noon)", "(Call|Ring|Text|Dial|Phone|Reach us on|Reach us at|WhatsApp) {P} (before|after|when|if) (noon|the gate is shut|you arrive|unsure).", "(call|ring|text) {P} or {P}(.|;)", "(tel|phone|mobile|fax)(=|:){P}(;|,|)", '"(phone|tel|mobile)": "{P}"', "The (vet|buyer|office|harbour office) is on {P}( now|.)", "(His|Her|My|Their) (number|mobile|phone) is {P}(.|,)", "{P} (is|was) (engaged|dead|the night line).", "({P}) {N}",
    # English, identities and addresses
    "(Passport|Passport no\\.|Passport number|ID|ID card|Identity card|National ID|Seafarer's book|Seaman's book|SSN|Social security no\\.|National insurance number|ID number|Licence)(:| no\\.| number| is|) {I}(.|,|;| shown at the gate| copied on {D})", "(id|ssn|passport|national_id)(=|: |:){I}(;|,|)", '"(passport|ssn|id_no|national_id)": "{I}"', "(He|She|The guest|The sailor) (showed|presented|carried|lost) (a passport|an identity card|the seaman's book) (\\({I}\\)|{I}|, {I},)(.| at the gate.)", "(Visitor|Guest|Sailor) {N} (with|showing) {I}(.| was let in.)", "(Visitor|Guest|Sailor) {N}, ID {I}(.|, was let in.)", "{N}, (passport|ID|SSN) {I}", "The (number|first line|entry) (on|of|in) (his|her|the) (passport|ID card|social security card|identity card|SSN form) (is|reads|says|seems to be) {I}(.|;)", "(Copy|Scan|Photo) of (the|a) (passport|ID card|seaman's book) with (the |)number {I}(.| kept.)", "{I} (is|was) the (ID|passport) (of|shown by) {N}.",
    "(Address|Home address|Ship to|Deliver to|Send to|Return to|Residence|Billing address): {A}(.|,|;|)( {L}|)", "(He|She|My aunt|The owner|The driver) (lives|stays|moved|works|has a flat) (at|to) {A}(.|, {L}.| now.)", "(Deliver|Ship|Send|Bring|Return|Take) the (boxes|parcel|papers|key) to {A}(.|, {L}| by {C}.| please.)", "(address|addr|street)(=|: |:){A}(;|\\||)", '"(address|street)": "{A}"', "{A}, {L}", "The (store|depot|office) (at|is at|moved to) {A}(, {L}|.| has new keys.)", "{N}\n{A}\n{L}", "{N} / {A} / {P}", "{N}, {A}, {E}", "(The crate|The pallet|The sample|The lot|Everything) (stays|waits|is kept|sits) at {A}(, {L}.|.|;| until {D}.)", "(Die Kiste|Die Ware|Das Los|Die Muster) (lagert|bleibt|wartet|steht) (in der |an der |beim Lager |){A}(, {L}.|.|;)", "(La caja|El lote|La muestra) (queda|espera|se guarda) en {A}(, {L}.|.|;)", "(Ang kahon|Ang lote|Ang sampol) ay (naiwan|nakatago) sa {A}(, {L}.|.)", "Meet (us|me) at {A}(.| at {C}.)", "A (parcel|letter) for {A} (came back|was lost).",
    # Spanish
    "(Firmado|Pesado|Contado|Aprobado|Escrito|Enviado) por {N}( el {D}|, {D}|.)", "(Hablé|Hablamos) con {N} (ayer|hoy|sobre el pedido).", "(Estimado|Estimada|Hola) {N}(,|:)", "(El señor|La señora|Don|Doña|Sr\\.|Sra\\.|El doctor|La doctora) {N} (llegó|llamó|firmó|salió)( a las {C}|).", "(Conductor|Cliente|Encargado|Encargada|Nombre|Titular|Responsable): {N}(.|;|,|)", "{N} (limpió|cerró|abrió|contó|pesó) (la nave|las cajas|el horno).", "(Pregunte|Preguntar|Avise|Diga) a {N} (si|que) (falta|vuelva) (algo|mañana).", "Según {N}, (todo|la puerta) está (bien|cerrada).", "(Teléfono|Tel\\.|Móvil|Fax|Tfno\\.)(:|) {P}(.|,|;|)", "(Llame|Llamar|Llamen) al {P} (antes|después|si) (de las doce|de salir|falta algo).", "(Correo|Escriba a|Escribir a|Enviar a|Contacto)(:|) {E}(.| o al {P}.)", "(DNI|NIE|Pasaporte|Libreta marítima|Documento|Seguridad social|N\\.º de afiliación)(:| n\\.º|) {I}(.|,|;|, titular {N}.)", "(Presentó|Mostró|Perdió) (el pasaporte|su DNI|la libreta) {I}( en la puerta|.)", "(Dirección|Domicilio|Entregar en|Enviar a)(:|) {A}(.|, {L}|;)", "(Vive|Reside|Trabaja) en {A}(.|, {L}.)", "(Lleve|Llevar|Entregar) (la caja|el paquete|las llaves) (a|en) {A}(.|, {L}.| antes de {C}.)", "{N} vive en {A} y (tiene|lleva) (llaves|guantes).",
    # German
    "(Gewogen|Gezählt|Unterschrieben|Freigegeben|Geschrieben|Abgeholt) von {N}( am {D}|, {D}|.)", "(Sehr geehrter|Sehr geehrte|Liebe|Lieber|Guten Tag) (Herr |Frau |){N},", "(Herr|Frau|Herr Dr\\.|Frau Prof\\.|Kapitän) {N} (kam|ging|rief an|unterschrieb)( um {C}|).", "(Fahrer|Fahrerin|Kunde|Kundin|Vorarbeiter|Name|Inhaber|Zeuge|Gast): {N}(.|;|,|)", "{N} (reinigte|schloss|öffnete|zählte|wog) (die Halle|die Kisten|das Tor).", "(Ich sprach|Wir sprachen) mit {N} (über die Lieferung|wegen der Rechnung).", "(Fragen Sie|Bitte fragen Sie|Sagen Sie|Bitte erinnern Sie) {N}(.|, ob etwas fehlt.)", "(Laut|Nach Angabe von) {N} (ist|war) (alles|die Waage) in Ordnung.", "(Telefon|Tel\\.|Handy|Mobil|Fax|Rufnummer)(:|) {P}(.|,|;|, Durchwahl 12|)", "(Rufen Sie|Bitte rufen Sie|Anruf unter|Erreichbar unter) {P}( an| vor Mittag|.)", "(E-Mail|Mail|Schreiben Sie an|Bitte an|Antwort an)(:|) {E}(.| oder {P}.)", "(Ausweis|Personalausweis|Reisepass|Pass|Passnummer|Seefahrtsbuch|Sozialversicherungsnummer|Ausweis-Nr\\.)(:| Nr\\.|) {I}(.|,|;|, Gast {N}.)", "(Er|Sie|Der Gast) (zeigte|verlor) (den Pass|den Ausweis) {I}( am Tor|.)", "(Anschrift|Adresse|Wohnung|Lieferadresse)(:|) {A}(.|, {L}|;)", "(Er|Sie|Der Fahrer|{N}) (wohnt|arbeitet) (in der |){A}(.| und hat Schlüssel.)", "(Bringen Sie|Liefern Sie|Schicken Sie) (das Paket|die Kiste|die Schlüssel) (zu|nach|an) {A}(.|, {L}.| bis {C}.)", "{N}, {A}, {P}",
    # Filipino
    "(Si|Kay|Ni) {N} (ang nagbilang|ang nagsara|ang naglinis|ang pumirma) (ng kahon|sa pinto|nang {C}).", "(Nilagdaan|Binilang|Tinimbang|Isinulat|Ipinadala) ni {N}( noong {D}|.)", "(Kausapin|Tanungin|Sabihan|Tawagin) si {N} (bukas|mamaya|bago umalis).", "(Mahal na|Kumusta,) {N},", "(Ginoong|Ginang|G\\.|Gng\\.|Aling|Mang) {N} (ay umalis|ay dumating)( nang {C}|).", "(Pangalan|Tsuper|Bisita|Mamimili): {N}(.|;|,|)", "(Telepono|Selpon|Tel\\.)(:|) {P}(.|,|;)", "(Tumawag|I-text|Tumawag kayo) sa {P} (bago|kung) (tanghali|may kulang).", "(Sumulat|Ipadala|Mag-email) sa {E}(.| o {P}.)", "(Pasaporte|PhilSys|SSS|TIN|UMID|Seaman's book|Kard ng pagkakakilanlan)(:| no\\.|) {I}(.|,|; may-ari {N})", "(Nakatira|Nagtatrabaho) (siya|si {N}) sa {A}(.|, {L}.)", "(Ihatid|Dalhin|Ipadala) ang (kahon|sulat|susi) sa {A}(.|, {L}.)", "(Tirahan|Direksyon): {A}(.|, {L}|;)", "Ayon kay {N}, (ayos|sarado) na ang (pinto|timbangan).",
    # hard negatives
    "(Lot|Batch|Pallet|Crate|Ticket|Specimen|Serial|Sample|Device|Order|Invoice|Container|Scale|Barcode|Part|Asset|Sensor|Meter|Job|Tag)( no\\.| number| #|) {T} (was|is) (moved|opened|late|logged|scrapped)( at {C}| on {D}|).", "(See|Closed|Opened|Related|Duplicate) (ticket|order|lot|crate|serial|batch|sample) {T}(.|,|;| and {T}.)", "The (scale|sensor|camera|printer|dryer) (with |)(serial |S/N |SN |model )(number |){T} (failed|works).", "(Readings|Counters|Serials|Lots|Values) {T} and {T} (belong|refer) to the (old|new) (dryer|line).", "{T};{T};{K};{D}", "{K} from (lot|batch|pallet) {T} (went|came) to {L}.", "(lot|sku|serial|ticket|batch|device)(=|: |:){T}(;|,|)", '"(lot|serial|ticket|device_id|sku|order)": "{T}"', "(The |){V} (landed|unloaded|brought|reported) {K}( at {L}| on {D}|).", "{K} from (the |){V} (was|were) (late|wet|small|rejected).", "(The crew of |Catch of |On board ){V} (was|is) (paid|checked)( at {L}|).", "The (truck|van|boat) (left|reached|passed) {L}( at {C}| on {D}|).", "{L} (was|is) (closed|wet|cold|full)( until {C}|).", "(Between|From) {L} (and|to) {L} the road (is|was) (closed|icy).", "{F} (sent|billed|sold) {K}.", "(The offer|An invoice) from {F} (is|was) (late|wrong).", "(Row|Rack|Lane|Shelf|Gate|Dock|Line|Bay|Door) 12 (Row|Rack|Lane|Shelf) 7 (was|were) (empty|swept).", "(Both|Two|The) (Models|Cameras|Lines) (Were|Are) (Fine|Slow).", "(First|Second|Last|Third|Next|Another) (Pass|Round|Check|Look|Try)(: |, )(nothing|all) (new|fine).", "(Erster|Letzter|Dritter|Neuer|Nächster) (Versuch|Lauf|Schritt|Termin|Wechsel)(: | )(alles|nichts) (gut|neu).", "(Primera|Última|Nueva) (Ronda|Vuelta|Prueba)(: | )(todo|nada) (bien|nuevo).", "(Daily|Weekly|Final|Quality) (Report|Control|Check|Audit|Summary)( {D}|:|)", "(Monday|Friday) (Morning|Evening|Shift) (Report|Notes|List)", "(Temperature|Humidity|Salt) (rose|fell) to {K} (at {C}|on {D}).", "File cap_{Z}.jpg (was|is) {K}.", "(Version|Release|Build) {Z}\\.2\\.1 (runs|works) since {D}.", "{Z} (times|boxes|trays|steps) (during|near|behind|on) the (pier|hill|wharf|square|quay|long lane|way) (shift|door|gate|round).", "(About|Over|Only) {Z} (fish|pieces|crates) (left|lay on|crossed) the (old|wet|last) (pier|road|way|lane|row) (today|at {C}|again).", "(Nach|In) {Z} (Schritten|Metern|Minuten) (am|zum|über den) (Kai|Platz|Weg) (war|ist) Schluss.", "(Page|Frame|Track|Image|Step) {Z} of {Z}(.|,)", "rig@{Z} (and|or) run@{Z}\\.4 (failed|passed)", "(Charge|Kiste|Palette|Probe|Seriennummer|Gerät|Bestellung|Rechnung|Los|Waage|Behälter)( Nr\\.|) {T} (kam|ging|fehlt|steht)( um {C}| am {D}|).", "(Die|Der) (Charge|Kiste|Probe|Waage|Zähler|Lieferung) {T} (ist|war) (nass|leer|offen).", "(Die {V}|Das Boot {V}|Der Kutter {V}) (brachte|lieferte) {K}( um {C}|).", "(Im|Am) {L} (war|ist) (alles|das Tor) (nass|zu).", "Messwert {Z},{Z} (Grad|Prozent) (bei|nach) {K}.", "(Tägliche|Letzte|Zweite) (Prüfung|Messung|Lieferung) (Ergebnis|Kontrolle|Liste): {K}.", "(Klasse|Gruppe|Linie) (Eins|Zwei|Drei) (Prüfung|Sperre|Ausgang) (war|ist) (fertig|offen).", "(Lote|Caja|Palé|Muestra|Serie|Pedido|Factura|Báscula|Bandeja)( n\\.º|) {T} (llegó|falta|salió)( a las {C}| el {D}|).", "(El|La) (lote|caja|muestra|báscula) {T} (está|estaba) (vacía|mojada|abierta).", "(El {V}|El barco {V}|La lancha {V}) (trajo|descargó) {K}( a las {C}|).", "(En|Cerca de|Desde) {L} (llueve|hay hielo|está cerrado).", "(Ang|Sa) (lote|kahon|sampol|tiket|timbangan) {T} ay (basa|kulang|bukas)( nang {C}| noong {D}|).", "(Ang|Mula sa) {V} ay (nagdala|may) ng {K}.", "Sa {L} ay (umuulan|sarado)( nang {C}|).",
    # hard negatives, decimal fractions
    "(Longitude|Easting|Offset|Drift)(:| is|) {G}(,|;) (swell low|no ice|anchor down).", "(lon|lng|x|loss|drift)(=|: |:){G}(;|,|)", '"(lon|lng|easting|loss)": {G}', "The (average|median|total) (drift|loss|torque|flow) (was|is) {G}( at {C}| on {D}|).", "(Längengrad|Mittelwert|Abweichung)( war| ist|:|) {G}(.|, {C}.|)", "(Longitud|Media|Desvío)( era| es|:|) {G}(.|, {C}.|)", "(Longhitud|Kabuuan)(:| ay) {G}(.|,)",
)

# Parts of invented words.
_GIVEN = ("Mar|El|Jo|Ka|Ro|Lu|Ti|An|Be|Da|Fer|Gus|Hen|Is|Nor|Pa|Se|Val|Zo|Mi|Ig|Ot|Wil|Bri|Cla|Jür|Ame|Lour|Rey|Dan|Cor|Ste".split("|"), "|i|a|e|o|ri|na|li|de|fa|me|ro".split("|"), "na|ta|do|s|n|ra|el|ck|bert|mund|line|ño|la|nda|ssa|vin|nor|th|que|ldo|mil".split("|"))
_FAMILY = ("Hart|Brand|Cas|Del|Monte|Roc|Sant|Bau|Krü|Stein|Mag|Pag|Lim|Tan|Wood|Ash|Fair|Quin|Vas|Bel|Dum|Esp|Gar|Hol|Kel|Lam|Mor|Nav|Ol|Pet|Rey|Sal|Tor|Ur|Wen|Yb|Zam".split("|"), "|a|e|i|o|en|ing|al|er|ul|ar".split("|"), "ley|well|berg|mann|ez|illa|ero|ado|ang|ayan|son|ton|worth|enko|ski|ñez|gado|bello|feld|stone|croft|dara|pan|quin|ante|huber|hauser|gate|mole|by".split("|"))
_PLACE = "Landing|Quay|Harbour|Bay|Point|Pier|Wharf|Market|Island|Slip|Cove|Bridge|Hall|Yard|Station|Beach|Lane|Row|Dock".split("|")
_COLOURS = "Grey|Silver|Northern|Blue|Old|White|Lucky|Golden|Little|Salt|Amber|Red|Morning|Wild|South|Green".split("|")
_THINGS = "Heron|Drift|Star|Gull|Wave|Anchor|Lady|Lantern|Tern|Spirit|Pearl|Hope|Whale|Storm|Petrel|Moon".split("|")


def _make(r: random.Random, parts) -> str:
    return "".join(r.choice(p) for p in parts)


def _thing(r: random.Random) -> str:
    """A thing's number: a known format, or any groups of digits; now and then with a digit too few."""
    if r.random() < 0.5:
        number = _digits(r, r.choice(_THING_NUMBERS))
    else:
        number = r.choice([" ", "-", ".", " "]).join("".join(r.choice("0123456789") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(2, 5)))
        number = r.choice(["0000 ", "00", "", ""]) + number
    if r.random() < 0.15 and len(number) > 7:
        at = r.randrange(1, len(number))
        number = number[:at] + number[at + 1 :]
    return number


def _digits(r: random.Random, form: str) -> str:
    """9 a digit, 8 one from 1 to 9, A a capital; other characters stay."""
    return "".join(str(r.randrange(10)) if c == "9" else str(r.randrange(1, 10)) if c == "8" else chr(65 + r.randrange(26)) if c == "A" else c for c in form)


def _name(r: random.Random) -> str:
    given, family = _make(r, _GIVEN), _make(r, _FAMILY)
    if r.random() < 0.06:
        given += "-" + _make(r, _GIVEN)
    if r.random() < 0.06:
        family = r.choice([f"{family}-{_make(r, _FAMILY)}", f"O'{family}", f"Mc{family}", f"de {family}", f"de la {family}", f"von {family}"])
    initial = chr(65 + r.randrange(26)) + "."
    form = r.random()
    name = f"{given} {family}" if form < 0.6 else f"{given[0]}. {family}" if form < 0.7 else f"{given[0]}. {initial} {family}" if form < 0.73 else f"{given} {initial} {family}" if form < 0.82 else f"{family}, {given}" if form < 0.91 else f"{family}, {given[0]}." if form < 0.93 else f"{given} {family.upper()}"
    return name.upper() if r.random() < 0.04 else name.lower() if r.random() < 0.04 else name


# Formats of phone numbers and of identity numbers.
_PHONES = "555-0199|899-9999|899.9999|899 9999|555 0199|555-0199|899-9999|(899) 555-0199|899-555-0199|899.555.0199|(899) 555 0199|+1 899 555 0199|+1 (899) 555-0199|+18995550199|020 7946 0999|01632 960999|07700 900999|+44 20 7946 0999|+44 7700 900999|+44 (0)1632 960999|0044 7700 900 999|00 44 20 7946 0999|+34 699 999 999|699 99 99 99|0034-699-999-999|(+34) 699.999.999|+34699999999|0171 9999999|0171-9999999|0171/9999999|030 9999999|(030) 99999999|030/99999-99|030 / 99999-99|+49 171 9999999|+49 (0)171-9999999|+49 30 99999 99|0049 171 9999999|+4917199999999|+63 899 999 9999|0899-999-9999|(0899) 9999999|0899 999 9999|+63899 9999999|+638999999999|(02) 8999 9999|+33 1 99 99 99 99|+31 20 999 9999".split("|")
_IDS = "999-99-9999|999 99 9999|899999999|AA 99 99 99 A|AA999999A|99999999A|99.999.999-A|99999999-A|A9999999A|A-9999999-A|AA9999999|A99999999|AA 999 9999|A99A99A99|AA99A99A9|9999-9999-9999-9999|9999 9999 9999 9999|99-9999999-9|999-999-999-999|AA-AA-999999|SB-999999|99 999999 A 999|9999999999|99 99 99 99 999|A999999999".split("|")
_THING_NUMBERS = "9999-9999-99|9999-999-999|A999-99|AA/99999|999-99-9999|9999 9999 9999 9999|999999999|AA9999999|899999|SN 9999-999-999|AA-9999-A|99999999|9999-99-9|A-999999|999.999.999|9999/99|AAA-99999|999 999 999|9999-99-99-9".split("|")


def _mail(r: random.Random) -> str:
    given, family = _make(r, _GIVEN).lower(), _make(r, _FAMILY).lower()
    user = r.choice([f"{given[0]}.{family}", f"{given}.{family}", given, f"{given}{r.randrange(99)}", f"{family}_{r.randrange(99)}", f"{given[0]}{family}", f"{given}-{family[0]}", f"{given}+{r.choice(['work', 'lab', 'x'])}", r.choice(["info", "office", "sales", "night.desk", "lab2", "x9_log"])])
    ascii_user = user.encode("ascii", "ignore").decode() or "office"
    host = r.choice(["example", "mail", "harbour-co", "fish.lab", "pier9", "post", family.encode("ascii", "ignore").decode() or "post"])
    end = r.choice(["com", "org", "net", "example", "test", "invalid", "de", "es", "ph", "co.uk"])
    full = f"{host}.{end}"
    form = r.random()
    if form < 0.7:
        return f"{ascii_user}@{full}"
    if form < 0.8:
        return f"{ascii_user} {r.choice(['(at)', '[at]'])} {full}"
    at, dot = r.choice([("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
    return f"{ascii_user}{at}{full.replace('.', dot)}"


def _address(r: random.Random) -> str:
    word, n = r.choice([_make(r, _FAMILY), r.choice(_COLOURS) + " " + r.choice(_THINGS), r.choice(_THINGS) + r.choice(["", "s", "gate", "field"])]), f"{r.randrange(1, 250)}{r.choice(['', '', '', 'a', 'B'])}"
    form = r.randrange(12)
    street = r.choice("Street|Road|Avenue|Lane|Way|Row|Drive|Close|Court|Square|Wharf|Quay|St.|Rd.|Ave|Ln|St|Rd".split("|"))
    unit = r.choice(["Flat", "Unit", "Apt", "Suite", "Floor", "Room"]) + f" {r.randrange(1, 40)}"
    if form < 4:
        out = [f"{n} {word} {street}", f"{unit}, {n} {word} {street}", f"{n} {word} {street}, {unit}", f"{n}, {word} {street}"][form]
    elif form < 6:
        small = r.choice(["", "de ", "de la ", "del ", "de los "])
        out = r.choice(["Calle ", "C/ ", "Avda. ", "Plaza ", "Paseo ", "Avenida ", "Camino "]) + small + word + r.choice([" ", ", ", ", n.º ", " núm. "]) + n + r.choice(["", "", ", 2.º B", ", 1.º A", ", piso 3"])
    elif form < 9:
        base = word.replace(" ", "").capitalize()
        out = r.choice([base + r.choice(["straße", "weg", "gasse", "str.", "platz", "allee", "ufer", "damm"]), "Am " + base + r.choice(["ufer", "kai", "markt", "hof"]), "An der " + base + "straße", base + "-Straße"]) + f" {n}" + r.choice(["", "", ", Haus 3", ", Whg. 4"])
    else:
        out = [f"{n} Kalye {word.split()[0]}", f"Blk {r.randrange(1, 40)} Lot {r.randrange(1, 40)}, {word.split()[0]} St.", f"{n} {word.split()[0]} St., Purok {r.randrange(1, 9)}"][form - 9]
    return out.upper() if r.random() < 0.04 else out


def _other(r: random.Random, slot: str) -> str:
    made = r.choice([_make(r, _FAMILY), r.choice(_COLOURS), r.choice(_THINGS)])
    two = f"{r.choice(_COLOURS)} {r.choice(_THINGS)}"
    return {
        "T": lambda: _thing(r), "V": lambda: f"{r.choice(['MV', 'FV', 'MB', 'FB', 'MS', 'F/V', 'M/V', 'RV'])} {r.choice([two, made, made + ' II', two])}",
        "L": lambda: r.choice([f"{made} {r.choice(_PLACE)}", f"{r.choice(_COLOURS)} {r.choice(_PLACE)}", f"Port {made}", f"San {made}", f"{made}hafen", f"Puerto {made}", made, f"{made} City", f"Barangay {made}"]),
        "F": lambda: f"{made} {r.choice(['Ltd', 'GmbH', 'Foods', 'Fisheries', 'S.L.', 'Inc', 'Trading', 'Fisch GmbH', '& Sons'])}", "D": lambda: r.choice([f"20{r.randrange(20, 40)}-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", f"{r.randrange(10, 29)}.0{r.randrange(1, 10)}.20{r.randrange(20, 40)}", f"{r.randrange(1, 29)} May", "Monday"]),
        "C": lambda: f"{r.randrange(24):02}:{r.randrange(60):02}", "K": lambda: f"{r.randrange(1, 4000)} {r.choice(['kg', 'trays', 'boxes', 'fish', 'g', 'pieces', 'Kisten', 'cajas', 'piraso'])}", "Z": lambda: str(r.randrange(1, 9999)),
        "G": lambda: _digits(r, r.choice(["199.9999", "199.9999", "89.99999", "899.9999", "199.999999", "8999.999"])),
    }[slot]()


_PERSONAL = {"N": ("name", _name), "E": ("email", _mail), "P": ("phone", lambda r: _digits(r, r.choice(_PHONES))), "I": ("id_number", lambda r: _digits(r, r.choice(_IDS))), "A": ("street_address", _address)}
_choice = re.compile(r"\(([^(){}\\]*(?:(?:\\.|\{\w\})[^(){}\\]*)*\|[^()\\]*(?:\\.[^()\\]*)*)\)")
_slot = re.compile(r"\{(\w)\}")


def _sentence(r: random.Random, form: str) -> tuple[str, set[tuple[str, int, int]]]:
    while (m := _choice.search(form)) is not None:
        form = form[: m.start()] + r.choice(m.group(1).split("|")) + form[m.end() :]
    form = form.replace("\\", "")
    out, spans, at = "", set(), 0
    for m in _slot.finditer(form):
        out += form[at : m.start()]
        kind, make = _PERSONAL.get(m.group(1), (None, lambda r: _other(r, m.group(1))))
        value = make(r)
        if value.endswith(".") and form[m.end() : m.end() + 1] == ".":  # the full stop is the sentence's
            value = value[:-1]
        if kind:
            spans.add((kind, len(out), len(out) + len(value)))
        out += value
        at = m.end()
    return out + form[at:], spans


def rows(n: int = ROWS, seed: int = 1, forms: tuple[str, ...] = FORMS) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """``n`` sentences with their (kind, start, end); every form is used, and equally often."""
    r = random.Random(seed)
    plain = [f for f in forms if not re.search(r"\{[NEPIA]\}", f)]
    out = []
    for i in range(n):
        text, spans = _sentence(r, forms[i % len(forms)])
        # some stand behind a word or a list sign, as in notes
        front = r.choice(["", "", "", "- ", "* ", "Note: ", "PS: ", "> "])
        if plain and text.endswith((".", "!")) and r.random() < 0.35:  # another sentence goes on behind it
            text += r.choice([" ", "  "]) + _sentence(r, r.choice(plain))[0]
        out.append((front + text, {(k, a + len(front), b + len(front)) for k, a, b in spans}))
    return out
