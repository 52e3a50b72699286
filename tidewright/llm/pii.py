"""Personal information in free text, found and replaced (problem 9).

High-recall generators propose overlapping spans of five kinds (pii_spans).
Boosted trees score each span by its format (lengths, groups, separators,
shape) and its context (words around it that introduce persons, numbers or
things, and what touches it); a threshold per kind, calibrated on held-out
texts, decides, and of overlapping accepted spans the best one stays.

No labelled rows of the corpus exist. Trees are fitted twice:

1. A teacher, on generated labelled sentences (pii_rows) and on evidence that
   holds anywhere: reviewers' names wherever they stand, plain mail addresses,
   phone numbers with a country code, and against a name its words in lower
   case elsewhere, vessels, reviewers' sites. It sees no corpus statistics.
2. The teacher scores every document once. Where it is sure, its spans give
   statistics: words of names, and the words around personal data. The final
   trees see these as well; they are fitted on the generated sentences and the
   sample's spans of which the teacher is sure and the words do not contradict.

The statistics come from aggregations over all documents. Only trees and
thresholds are fitted on a sample, on the driver: SAMPLE documents of at most
SAMPLE_CHARS characters, those with the smallest hashes of their identifiers.
No kind lacks examples, for the generated sentences have them all. The model is
broadcast (its size is checked). It holds the WORDS and KEYS most frequent
statistics; if there are more, a text's rarer ones are joined to it before it
is scanned, so every statistic counts and the findings are the same whatever
these two are. All documents are then scanned whole.

A text is scanned sentence by sentence, cut where no span can cross. Sentences
equal but for digits are scored once per task and remembered: no statistic and
no feature depends on a digit other than a leading zero.

Defined results: null and blank texts have no findings and are returned as
they are; equal findings of a document appear once.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import pii_rows
from tidewright.llm.boosting import Boosted
from tidewright.llm.pii_spans import CUE_NAMES, CUE_OF, KINDS, candidates, digits_of, free_word, is_date, is_position, word
from tidewright.session import cut, spread

SAMPLE = 4000
SAMPLE_CHARS = 20_000
MODEL_BYTES = 64 << 20
#: Words of names and keys of contexts that the model holds: the most frequent ones. The others are joined to the texts that ask for them.
WORDS, KEYS = 400_000, 200_000
#: About as many negatives of a kind, evenly taken from the sample's, are learnt from; all held-out ones set the threshold.
NEGATIVES = 8000
#: Log-odds from which the teacher counts as sure.
CONFIDENT = 1.5
#: Margin in log-odds from which of overlapping spans the longest stays.
SURE = 2.0
#: Sentences remembered in a task.
REMEMBERED = 50_000

# --- sentences ----------------------------------------------------------------------------------------------

_NINES = str.maketrans("012345678", "999999999")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part): lines, cut behind a full stop after five letters and before a letter; no span crosses such a place."""
    at = 0
    for line in text.split("\n"):
        start = end = at
        for piece in line.split(". "):
            if end > start and piece[:1].isalpha() and end - start >= 7 and text[end - 7 : end - 2].isalpha():
                yield start, text[start : end - 1]
                start = end
            end += len(piece) + 2
        yield start, text[start : at + len(line)]
        at += len(line) + 1


# --- features -----------------------------------------------------------------------------------------------

_token = re.compile(rf"{word.pattern}(?:/{word.pattern})?|\d+|[^\w\s]|_")
_run_of_word, _small_letters, _capital, _digit, _not_latin = re.compile(r"\w+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]"), re.compile(r"\d"), re.compile("[^A-Za-zÀ-ÿ]+")
_CUES = range(len(CUE_NAMES))
_cue_bits = lambda *names: sum(1 << CUE_NAMES.index(n) for n in names)
_FRONT, _BACK, _THINGS = _cue_bits("title", "marker", "role", "speech", "id", "phone", "mail", "address", "agent"), _cue_bits("place", "firm"), _cue_bits("thing", "vessel", "unit", "place", "firm")
_NUMERIC = ("phone", "id_number")


class Sentence:
    """A text's tokens with their places and cues."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = [(m.start(), m.group()) for m in _token.finditer(text)]
        self.starts = [s for s, _ in found]
        self.tokens = [t for _, t in found]
        self.low = ["9" if t[0].isdigit() else t.lower() for t in self.tokens]
        self.cues = [CUE_OF.get(t, 0) for t in self.low]

    def stops(self, k: int) -> bool:
        """Whether a sentence ends at token k: a full stop behind no initial or cue, such as "tel.", and before a capital."""
        return self.tokens[k] in ".!?" and k > 0 and len(self.tokens[k - 1]) > 1 and not self.cues[k - 1] and k + 1 < len(self.tokens) and self.tokens[k + 1][0].isupper()

    def cues_left(self, i: int) -> list[int]:
        """Cues of the seven tokens before token i in its sentence, the nearest first."""
        first = next((k + 1 for k in range(i - 1, max(-1, i - 8), -1) if self.stops(k)), max(0, i - 7))
        return self.cues[first:i][::-1]

    def nested(self, spans: list[tuple[str, int, int]]) -> None:
        """Remembers, for each candidate, which candidates of its kind hold it or lie in it."""
        flags = {span: [False] * 4 for span in spans}
        for kind in KINDS:
            same = sorted((a, b) for k, a, b in spans if k == kind)
            for i, (a, b) in enumerate(same):
                for j in range(i + 1, len(same)):
                    x, y = same[j]
                    if x >= b:
                        break
                    outer, inner = ((a, b), (x, y)) if b >= y else ((x, y), (a, b))
                    if outer[0] > inner[0]:
                        continue  # they only cross
                    flags[kind, *outer][3] = True
                    flags[kind, *inner][0 if outer[0] == inner[0] else 1 if outer[1] == inner[1] else 2] = True
        self.nest = flags

    def around(self, a: int, b: int) -> tuple[int, int]:
        """Numbers of the first token inside and the first behind."""
        return bisect_left(self.starts, a), bisect_left(self.starts, b)


def shape(span: str) -> str:
    """Letters as A or a, digits as 9 (run lengths kept for digits and capitals only)."""
    folded = span if span.isascii() else unicodedata.normalize("NFKC", span)
    return _small_letters.sub("a", _digit.sub("9", _capital.sub("A", folded)))


def keys(s: Sentence, kind: str, a: int, b: int) -> list[str]:
    """Keys whose share of positives is a feature."""
    i, j = s.around(a, b)
    before, after = ["-", "-", "-", *s.low[max(0, i - 3) : i]][-3:], [*s.low[j : j + 2], "-", "-"][:2]
    span = s.text[a:b]
    return [
        f"{kind}<1 {before[2]}", f"{kind}<2 {before[1]} {before[2]}", f"{kind}<3 {' '.join(before)}", f"{kind}>1 {after[0]}", f"{kind}>2 {after[0]} {after[1]}", f"{kind}<> {before[2]} {after[0]}", f"{kind}s {shape(span)}",
        f"{kind}f {_not_latin.split(span.strip('( +'))[0].lower() if kind == 'street_address' else len(span.split())}",
    ]


def plain(s: Sentence, kind: str, a: int, b: int) -> list[float]:
    """Features of format and context that need no statistics."""
    text = s.text
    span = text[a:b] if text.isascii() else unicodedata.normalize("NFC", text[a:b])
    digits, upper, letters = digits_of(span), sum(map(str.isupper, span)), sum(map(str.isalpha, span))
    groups = [len(g) for g in _run_of_word.findall(span)]
    i, j = s.around(a, b)
    left, right = text[a - 1 : a], text[b : b + 1]
    joined_left = a > 1 and left in " .-/" and (text[a - 2].isdigit() or (text[a - 2].isupper() and kind == "id_number"))
    joined_right = b + 1 < len(text) and right in " .-/" and (text[b + 1].isdigit() or (text[b + 1].isupper() and kind == "id_number"))
    words = [k for k in range(i, j) if len(s.tokens[k]) > 1 and s.tokens[k][0].isalpha()]
    inside = [s.cues[k] for k in words]
    before, after = (s.tokens[i - 1] if i else ""), (s.tokens[j] if j < len(s.tokens) else "")
    out = [
        len(span), digits, letters, upper, letters - upper, len(groups), *(groups + [0, 0, 0, 0])[:4], groups[-1] if groups else 0,
        span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("(") + span.count("["), span.count(","),
        span[:1] in "+＋", span[:1] in "(（", span.startswith("00"), span.lstrip("+＋(（").startswith("0"), span.isascii(), "@" in span, span[-1:] == ".",
        not left, left == " ", left in "([{<\"'“„«" and left != "", left in "=:|/;\t" and left != "", not right or right in "\r", right == " ", right == ".", right in ",;:)]}>|\"" and right != "",
        joined_left, joined_right, before.isdigit(), before[:1].isupper(), before[:1].islower(), bool(before) and not before[:1].isalnum(), after.isdigit(), after[:1].isupper(), after[:1].islower(),
        len(words), sum(s.tokens[k].islower() and len(s.tokens[k]) > 3 for k in words), bool(inside) and inside[0] & _FRONT > 0, bool(inside) and inside[-1] & _BACK > 0, sum(c & _THINGS > 0 for c in inside), sum(c > 0 for c in inside), all(s.tokens[k][0].isupper() for k in words), span.isupper(),
    ]
    out += s.nest[kind, a, b]
    for cue in (s.cues_left(i), s.cues[j : j + 3]):
        near = [0] * len(CUE_NAMES)
        for distance, bits in enumerate(cue):
            if bits:
                for c in _CUES:
                    if bits >> c & 1 and not near[c]:
                        near[c] = 8 - distance
        out += near
    return [float(v) for v in out]


def statistics(s: Sentence, kind: str, a: int, b: int, shares: dict[str, float], lexicon: dict[str, float]) -> list[float]:
    """Features that come from the statistics of all documents."""
    i, j = s.around(a, b)
    likely = [lexicon.get(w, 0.0) for w in _name_words(s.text[a:b])] or [0.0]
    beside = [lexicon.get(s.low[k], 0.0) if 0 <= k < len(s.low) else 0.0 for k in (i - 1, j)]
    return [*(shares.get(k, 0.0) for k in keys(s, kind, a, b)), min(likely), max(likely), float(sum(v > 0 for v in likely)), float(sum(v > 0 for v in likely) / len(likely)), *beside]


# --- labels -------------------------------------------------------------------------------------------------


class Evidence:
    """What is known without any labelled row: reviewers, their sites, and words in lower case."""

    def __init__(self, people: list[tuple[str | None, str | None]], sites: list[str | None], common: set[str]) -> None:
        self.pairs = {(g.lower(), f.lower()) for g, f in people if g and f}
        self.families = {f for _, f in self.pairs}
        self.words = {w for person in people for part in person if part for w in word.findall(part.lower())}
        self.sites = {s.lower() for s in sites if s}
        self.common = common

    def is_person(self, span: str) -> bool:
        """A reviewer's given name or initials with the family name, in either order."""
        parts = [w.lower() for w in word.findall(span)]
        full = [w for w in parts if len(w) > 1]
        if len(full) == 2:
            return (full[0], full[1]) in self.pairs or (full[1], full[0]) in self.pairs
        return len(full) == 1 and len(parts) > 1 and full[0] in self.families and any(f == full[0] and parts[0][0] == g[0] for g, f in self.pairs)

    def label(self, s: Sentence, kind: str, a: int, b: int) -> int | None:
        """1 or 0 where the span speaks for itself, else None."""
        span = s.text[a:b]
        if kind == "name":
            if self.is_person(span):
                return 1
            i, _ = s.around(a, b)
            if i and s.cues[i - 1] & _cue_bits("vessel") or span.lower() in self.sites:
                return 0
            return 0 if any(w.lower() in self.common for w in word.findall(span)) else None
        if kind == "email":
            return 1 if re.fullmatch(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)*\.[a-z]{3,}", span, re.I) and not re.search(r"@\d", span) else None
        if kind == "phone" and span[0] in "+＋" and 10 <= digits_of(span) <= 15 and not s.text[b : b + 1].isdigit():
            return None if re.match(r"[ \-/.]\d", s.text[b : b + 2]) else 1
        if kind == "street_address" and any(w.islower() and len(w) > 1 and w not in IN_ADDRESSES for w in word.findall(span)):
            return 0
        return None


# Words in lower case that may stand in a street address.
IN_ADDRESSES = frozenset("de del la el los las y der dem den an am auf zur zum flat unit floor house haus apt room suite block lot purok piso planta puerta no núm".split())


def _common(texts: list[str]) -> set[str]:
    """Words that stand in lower case at least twice and in a fifth of their places."""
    small, big = Counter(), Counter()
    for text in texts:
        for w in free_word.findall(text):
            if len(w) > 1:
                (small if w[0].islower() else big)[w.lower()] += 1
    return {w for w, n in small.items() if n > 1 and n * 4 >= big[w]}


def _name_words(span: str) -> list[str]:
    """A span's words of more than one letter, as the lexicon has them."""
    return [unicodedata.normalize("NFC", w.lower()) for w in word.findall(span) if len(w) > 1]


def _flags(text: str, kind: str, a: int, b: int) -> int:
    """What a span's digits may say beyond being digits; from 4, that it is a date or part of a position and no candidate."""
    if kind not in _NUMERIC:
        return 0
    span = text[a:b]
    return 4 if is_date(span) or ("." in span and is_position(text, a, b)) else 2 * span.startswith("00") + span.lstrip("+＋(（").startswith("0")


def _meets(intervals: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps any of the intervals."""
    starts: list[int] = []
    ends: list[int] = []
    for x, y in sorted(intervals):
        if starts and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)

    def meets(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1
        return i >= 0 and ends[i] > a

    return meets


def _resolve(scored: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str, float]]:
    """Accepted spans without overlaps: by margin, then the longest."""
    taken: list[tuple[int, int, str, float]] = []
    for m, a, b, kind in sorted(scored, key=lambda s: (-min(s[0], SURE), s[1] - s[2], s[1])):
        i = bisect_left(taken, (b,))
        if i == 0 or taken[i - 1][1] <= a:
            insort(taken, (a, b, kind, m))
    return taken


class Scorer:
    """Trees over sentences; sentences equal but for digits are scored once."""

    def __init__(self, model: dict) -> None:
        self.model = self.own = model
        self.known = frozenset(w for w, v in model["lexicon"].items() if v > 0)
        self.spans: dict[str, list[tuple[str, int, int]]] = {}
        self.done: dict[tuple, object] = {}

    def lend(self, rare: dict[str, tuple[int, int]]) -> None:
        """Counts of the rare keys that the next texts ask for, in place of those lent before."""
        own, totals = self.own, self.own["totals"]
        words, keys_ = ([{k[1:]: n[i] for k, n in rare.items() if k[0] == sign} for i in (0, 1)] for sign in "wk")
        self.model = own | {"lexicon": own["lexicon"] | _lexicon(*words, set()), "shares": own["shares"] | _shares(keys_[0] | totals[0], keys_[1] | totals[1])}
        self.known = frozenset(w for w, v in self.model["lexicon"].items() if v > 0)

    def keyed(self, part: str) -> tuple[tuple, list[tuple[str, int, int]]] | None:
        """The key of a sentence and its candidates."""
        same = part.translate(_NINES)
        spans = self.spans.get(same)
        if spans is None:
            spans = self.spans[same] = candidates(same, self.known)
        if not spans:
            return None
        flags = bytes([_flags(part, *span) for span in spans])
        return (same, flags), [s for s, f in zip(spans, flags) if f < 4]

    def margins(self, todo: list[tuple[Sentence, list[tuple[str, int, int]]]]) -> list[list[float]]:
        """Log-odds above the threshold of each candidate of each sentence."""
        model, out = self.model, [[0.0] * len(spans) for _, spans in todo]
        for kind in KINDS:
            places = [(n, k) for n, (_, spans) in enumerate(todo) for k, span in enumerate(spans) if span[0] == kind]
            for at in range(0, len(places), 20_000):
                some = places[at : at + 20_000]
                rows = []
                for n, k in some:
                    s, (_, a, b) = todo[n][0], todo[n][1][k]
                    rows.append(plain(s, kind, a, b) + (statistics(s, kind, a, b, model["shares"], model["lexicon"]) if model["final"] else []))
                scores = model["trees"][kind].score(np.array(rows)) - model["cuts"][kind]
                for (n, k), v in zip(some, scores.tolist()):
                    out[n][k] = v
        return out

    def run(self, texts: list[str | None], finish: Callable) -> list[list[tuple[int, object]]]:
        """(offset, result) of each text's sentences; finish turns a sentence, its candidates and their margins into a result."""
        if len(self.spans) > REMEMBERED or len(self.done) > REMEMBERED:
            self.spans, self.done = {}, {}
        todo, keys_ = [], {}
        plan: list[list[tuple[int, tuple]]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            for offset, part in sentences(text) if text and text.strip() else ():
                if len(part) > 4 and (found := self.keyed(part)):
                    key, spans = found
                    plan[i].append((offset, key))
                    if key not in self.done and key not in keys_:
                        keys_[key] = len(todo)
                        todo.append((Sentence(part), spans))
                        todo[-1][0].nested(spans)
        for key, (s, spans), margins in zip(keys_, todo, self.margins(todo)):
            self.done[key] = finish(s, spans, margins)
        return [[(offset, self.done[key]) for offset, key in of] for of in plan]


def _accepted(s: Sentence, spans: list[tuple[str, int, int]], margins: list[float]) -> list[tuple[int, int, str, float]]:
    return _resolve([(m, a, b, kind) for m, (kind, a, b) in zip(margins, spans) if m > 0])


def _taught(evidence: Evidence) -> Callable:
    """(sentence, [(kind, a, b, label)]) of the candidates on which evidence or the teacher is sure."""

    def finish(s: Sentence, spans: list[tuple[str, int, int]], margins: list[float]):
        clear = {span: evidence.label(s, *span) for span in spans}
        raised = [(m + 10 if clear[span] == 1 else m, *span[1:], span[0]) for m, span in zip(margins, spans) if clear[span] == 1 or (m > 0 and clear[span] is None)]
        best = {(kind, a, b): m for a, b, kind, m in _resolve(raised)}
        out, covered = [], _meets((a, b) for (_, a, b), v in best.items() if v >= CONFIDENT)
        for m, span in zip(margins, spans):
            if span in best:
                label = 1 if best[span] >= CONFIDENT else None
            elif covered(*span[1:]):
                label = 0
            else:
                label = 0 if clear[span] == 0 or m <= -CONFIDENT else None
            if label is not None:
                out.append((*span, label))
        return s, out

    return finish


# --- model --------------------------------------------------------------------------------------------------


def _lexicon(inside: dict[str, int], everywhere: dict[str, int], known: set[str]) -> dict[str, float]:
    """Words of names: the log-odds that a word, wherever it occurs, stands in a name."""
    out = {}
    for w in {*inside, *known}:
        n, all_ = inside.get(w, 0), everywhere.get(w, 0)
        if n * 3 > all_ or w in known:
            out[w] = float(np.log((n + 2 * (w in known) + 0.1) / (max(0, all_ - n) + 0.5)))
    return out


def _shares(no: dict[str, int], yes: dict[str, int]) -> dict[str, float]:
    """Log of how much more often a key stands at positives than at negatives of its kind."""
    out = {}
    for k in {*no, *yes}:
        kind = k if k in KINDS else next(name for name in KINDS if k.startswith(name))
        if k not in KINDS and no.get(k, 0) + yes.get(k, 0) >= 3:
            n, y = max(1, no.get(kind, 0)), max(1, yes.get(kind, 0))
            out[k] = float(np.log((yes.get(k, 0) / y * 1000 + 0.5) / (no.get(k, 0) / n * 1000 + 0.5)))
    return out


def _generated(rows: list[tuple[str, set[tuple[str, int, int]]]], known: frozenset[str]) -> Iterator[tuple[Sentence, list[tuple[str, int, int, int]]]]:
    for text, true in rows:
        s, spans = Sentence(text), [c for c in candidates(text, known) if _flags(text, *c) < 4]
        s.nested(spans)
        yield s, [(*c, int(c in true)) for c in spans]


def _trees(taught: list[tuple[int, Sentence, list[tuple[str, int, int, int]]]], describe: Callable) -> tuple[dict, dict]:
    """Trees and thresholds by kind; groups divisible by 4 are held out and set the thresholds."""
    trees, cuts = {}, {}
    for kind in KINDS:
        rows = [(group, s, a, b, label) for group, s, spans in taught for k, a, b, label in spans if k == kind]
        x = np.array([describe(s, kind, a, b) for _, s, a, b, _ in rows])
        y, held = np.array([r[4] for r in rows]), np.array([r[0] % 4 == 0 for r in rows])
        learn = np.flatnonzero(~held)
        no = learn[y[learn] == 0]
        learn = np.r_[learn[y[learn] == 1], no[:: 1 + len(no) // NEGATIVES]]
        trees[kind] = Boosted().fit(x[learn], y[learn])
        cuts[kind] = _calibrated(trees[kind].score(x[held]), y[held])
    return trees, cuts


def _calibrated(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of most F1 on the held-out spans; in a gap its middle, at most a little off even odds."""
    if y.sum() == 0:
        return 0.0
    order = np.argsort(-score)
    s, hit = score[order], y[order].cumsum()
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    best = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    below = s[best + 1] if best + 1 < len(s) else s[best] - 2
    return float(np.clip((s[best] + below) / 2, -1.0, 1.0))


def teach(texts: list[str], evidence: Evidence, rows: list | None = None) -> dict:
    """The teacher: trees on generated rows and on evidence in the texts, without statistics."""
    taught = [(i, s, spans) for i, (s, spans) in enumerate(_generated(rows if rows is not None else pii_rows.rows(), frozenset()))]
    known, seen = frozenset(evidence.words), set()
    for i, text in enumerate(texts):
        for _, part in sentences(text):
            if (same := part.translate(_NINES)) in seen or len(part) < 5:
                continue
            seen.add(same)
            s, found = Sentence(part), [c for c in candidates(part, known) if _flags(part, *c) < 4]
            s.nested(found)
            marked = [(c, evidence.label(s, *c)) for c in found]
            covered = _meets(c[1:] for c, label in marked if label == 1)
            spans = []
            for c, label in marked:
                if label is None and covered(*c[1:]):
                    label = 0
                if label is not None:
                    spans.append((*c, label))
            if spans:
                taught.append((i, s, spans))
    trees, cuts = _trees(taught, plain)
    return {"lexicon": {w: 1.0 for w in evidence.words}, "shares": {}, "trees": trees, "cuts": cuts, "final": False}


def _count(texts: list[str], scorer: Scorer, evidence: Evidence) -> tuple[Counter, Counter]:
    """Counts by key of a batch: ``w`` words in sure names and everywhere, ``k`` keys at negatives and at positives."""
    first, second = Counter(), Counter()
    results = scorer.run(texts, lambda s, spans, m: _counted_sentence(*_taught(evidence)(s, spans, m)))
    for of in results:
        for _, (yes_words, no_keys, yes_keys) in of:
            first.update(yes_words)
            first.update(no_keys)
            second.update(yes_keys)
    for text in texts:
        second.update("w" + w.lower() for w in free_word.findall(unicodedata.normalize("NFC", text)) if len(w) > 1)
    return first, second


def _counted_sentence(s: Sentence, spans: list[tuple[str, int, int, int]]) -> tuple[list[str], list[str], list[str]]:
    words, by_label = [], ([], [])
    for kind, a, b, label in spans:
        by_label[label].append("k" + kind)
        by_label[label].extend("k" + k for k in keys(s, kind, a, b))
        if label and kind == "name":
            words += ["w" + w for w in _name_words(s.text[a:b])]
    return words, *by_label


def finish(texts: list[str], teacher: dict, evidence: Evidence, first: dict[str, int], second: dict[str, int], rows: list | None = None) -> dict:
    """The final model from the teacher and the counts of all documents."""
    word_counts = [{k[1:]: n for k, n in c.items() if k[0] == "w"} for c in (first, second)]
    key_counts = [{k[1:]: n for k, n in c.items() if k[0] == "k"} for c in (first, second)]
    lexicon, shares = _lexicon(*word_counts, evidence.words), _shares(*key_counts)
    known = frozenset(w for w, v in lexicon.items() if v > 0)
    taught = [(i, s, spans) for i, (s, spans) in enumerate(_generated(rows if rows is not None else pii_rows.rows(), known))]
    scorer, seen = Scorer(teacher | {"lexicon": lexicon}), set()
    for i, of in enumerate(scorer.run(texts, _taught(evidence))):
        for _, (s, spans) in of:
            if id(s) not in seen:
                seen.add(id(s))
                # words that stand in names elsewhere contradict a no, and leave the span out
                covered = _meets((a, b) for _, a, b, label in spans if label)
                taught.append((i, s, [c for c in spans if c[3] or c[0] != "name" or covered(*c[1:3]) or not _like_names(s, c, lexicon)]))
    trees, cuts = _trees(taught, lambda s, kind, a, b: plain(s, kind, a, b) + statistics(s, kind, a, b, shares, lexicon))
    return {"lexicon": lexicon, "shares": shares, "totals": [{k: c.get(k, 0) for k in KINDS} for c in key_counts], "trees": trees, "cuts": cuts, "final": True}


def _like_names(s: Sentence, span: tuple, lexicon: dict[str, float]) -> bool:
    """Whether every word of the span stands in names elsewhere."""
    return all(lexicon.get(w, 0.0) > 0 for w in _name_words(s.text[span[1] : span[2]]))


def fit(texts: list[str], people: list[tuple[str | None, str | None]], sites: list[str | None] = (), rows: list | None = None) -> dict:
    """The model of texts that are all documents."""
    evidence = Evidence(people, list(sites), _common(texts))
    teacher = teach(texts, evidence, rows)
    return finish(texts, teacher, evidence, *_count(texts, Scorer(teacher), evidence), rows)


def scan(text: str | None, model: dict) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order, without overlaps."""
    return scan_all([text], Scorer(model))[0]


def scan_all(texts: list[str | None], scorer: Scorer) -> list[list[tuple[int, int, str]]]:
    """scan of each text."""
    return [[(offset + a, offset + b, kind) for offset, spans in of for a, b, kind, _ in spans] for of in scorer.run(texts, _accepted)]


# --- over a table -------------------------------------------------------------------------------------------


class _Asked:
    """In place of words or shares: has everything, and notes the keys that are not held."""

    def __init__(self, sign: str, held: Container[str]) -> None:
        self.sign, self.held, self.noted = sign, held, set()

    def __contains__(self, key: str) -> bool:
        if key not in self.held:
            self.noted.add(self.sign + key)
        return True

    def get(self, key: str, default: float) -> float:
        return default if key in self else 0.0


def _asked(text: str, lexicon: Container[str], shares: Container[str]) -> set[str]:
    """Keys that are not held and that a scan of the text may look up."""
    words, keys_ = _Asked("w", lexicon), _Asked("k", shares)
    for _, part in sentences(text):
        if len(part) > 4:
            s = Sentence(part)
            for span in candidates(part.translate(_NINES), words):
                statistics(s, *span, keys_, words)
    return words.noted | keys_.noted


def _counted(documents: DataFrame, teacher: dict, evidence: Evidence) -> DataFrame:
    """(key, a, b): the two counts over all documents of every key that matters."""
    shipped = _broadcast(documents, teacher | {"evidence": evidence})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _read(shipped.value)
        scorer = Scorer(loaded)
        for batch in batches:
            a, b = _count([t for t in batch.column(0).to_pylist() if t and t.strip()], scorer, loaded["evidence"])
            found = list({*a, *b})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([a[k] for k in found], pa.int64()), pa.array([b[k] for k in found], pa.int64())], ["key", "a", "b"])

    part = spread(documents.select("text", "doc_id"), "doc_id").select("text").mapInArrow(run, "key string, a bigint, b bigint")
    sums = part.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    names: Column = F.col("key").startswith("w") & (F.expr("a > 0 and a * 3 > b") | F.substring("key", 2, 1 << 20).isin(evidence.words))
    return cut(sums.where(names | (F.col("key").startswith("k") & (F.col("a") + F.col("b") >= 3))))


def _held(counts: DataFrame, evidence: Evidence) -> tuple[dict[str, tuple[int, int]], bool]:
    """The counts that the model holds, and whether these are all."""
    words, keys_ = counts.where("key like 'w%'").orderBy(F.desc("a"), "key").limit(WORDS + 1), counts.where("key like 'k%'").orderBy(F.expr("a + b").desc(), "key").limit(KEYS + 1)
    rows = words.unionByName(keys_).collect()
    by_sign = [[r for r in rows if r["key"][0] == sign] for sign in "wk"]
    if len(by_sign[0]) <= WORDS and len(by_sign[1]) <= KEYS:
        return {r["key"]: (r["a"], r["b"]) for r in rows}, True
    always = counts.where(F.col("key").isin(["k" + kind for kind in KINDS]) | (F.col("key").startswith("w") & F.substring("key", 2, 1 << 20).isin(evidence.words))).collect()
    return {r["key"]: (r["a"], r["b"]) for r in [*by_sign[0][:WORDS], *by_sign[1][:KEYS], *always]}, False


def train(documents: DataFrame, reviewers: DataFrame) -> dict:
    """The model: statistics of all documents, and trees fitted on the bounded sample described above."""
    sample = documents.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    texts = [r["text"] for r in sample]
    site = F.col("site") if "site" in reviewers.columns else F.lit(None).cast("string")
    rows = reviewers.select("given_name", "family_name", site.alias("site")).collect()
    evidence = Evidence([(r[0], r[1]) for r in rows], [r[2] for r in rows], _common(texts))
    teacher = teach(texts, evidence)
    counts = _counted(documents, teacher, evidence)
    held, all_held = _held(counts, evidence)
    seen = held
    if not all_held:  # the fit sees the others that its texts ask for
        words, keys_ = evidence.words | {k[1:] for k in held if k[0] == "w"}, {k[1:] for k in held if k[0] == "k"}
        asked = {k for t in [*texts, *(t for t, _ in pii_rows.rows())] for k in _asked(t, words, keys_)}
        more = counts.join(documents.sparkSession.createDataFrame([(k,) for k in asked], "key string"), "key").collect()
        seen = held | {r["key"]: (r["a"], r["b"]) for r in more}
    model = finish(texts, teacher, evidence, *({k: n[i] for k, n in seen.items()} for i in (0, 1)))
    if not all_held:
        model |= {"lexicon": {w: v for w, v in model["lexicon"].items() if w in words}, "shares": {k: v for k, v in model["shares"].items() if k in keys_}, "rare": counts}
    return model


def _broadcast(documents: DataFrame, model: dict):
    """The model as bytes, trees as plain values, so that executors need no import to read them."""
    data = pickle.dumps({k: v for k, v in model.items() if k != "rare"} | {"trees": {k: t if isinstance(t, dict) else dict(vars(t)) for k, t in model["trees"].items()}})
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    return documents.sparkSession.sparkContext.broadcast(data)


def _read(data: bytes) -> dict:
    model = pickle.loads(data)  # noqa: S301 - written by _broadcast
    return model | {"trees": {k: Boosted(**t) for k, t in model["trees"].items()}}


def _with_rare(documents: DataFrame, model: dict, shipped) -> DataFrame:
    """(doc_id, text, rare): with the counts that a text asks for and the model does not hold; equal texts ask once a batch."""
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.get("rare") is None:
        return spread(out.withColumn("rare", F.lit(None).cast("array<struct<key:string,a:bigint,b:bigint>>")), "doc_id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _read(shipped.value)
        for batch in batches:
            ids, found = [], []
            for text_id, text in dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).items():
                if text and text.strip():
                    asked = _asked(text, loaded["lexicon"], loaded["shares"])
                    ids += [text_id] * len(asked)
                    found += asked
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["text_id", "key"])

    out = out.withColumn("text_id", F.sha2("text", 256))
    asked = spread(out, "doc_id").select("text_id", "text").mapInArrow(ask, "text_id string, key string").distinct()
    rare = asked.join(model["rare"], "key").groupBy("text_id").agg(F.collect_list(F.struct("key", "a", "b")).alias("rare"))
    return spread(out.join(rare, "text_id", "left").select("doc_id", "text", "rare"), "doc_id")


def _scan_batch(batch: pa.RecordBatch, scorer: Scorer) -> list[list[tuple[int, int, str]]]:
    """scan_all of a batch of (doc_id, text, rare)."""
    if batch.column(2).null_count < batch.num_rows:
        scorer.lend({r["key"]: (r["a"], r["b"]) for of in batch.column(2).to_pylist() if of for r in of})
    return scan_all(batch.column(1).to_pylist(), scorer)


def findings(documents: DataFrame, reviewers: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, kind, value): each finding of a document once."""
    model = model or train(documents, reviewers)
    shipped = _broadcast(documents, model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_read(shipped.value))
        for batch in batches:
            ids, kinds, values = [], [], []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _scan_batch(batch, scorer)):
                for kind, value in dict.fromkeys((kind, text[a:b]) for a, b, kind in spans):
                    ids.append(doc_id)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["doc_id", "kind", "value"])

    return _with_rare(documents, model, shipped).mapInArrow(find, "doc_id bigint, kind string, value string")


def redacted(documents: DataFrame, reviewers: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, text, n_findings): texts with [NAME], [EMAIL] ... in place of what was found."""
    model = model or train(documents, reviewers)
    shipped = _broadcast(documents, model)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_read(shipped.value))
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(batch.column(1).to_pylist(), _scan_batch(batch, scorer)):
                counts.append(len(spans))
                at, parts = 0, []
                for a, b, kind in spans:
                    parts += [text[at:a], f"[{kind.upper()}]"]
                    at = b
                texts.append(text if not spans else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n_findings"])

    return _with_rare(documents, model, shipped).mapInArrow(redact, "doc_id bigint, text string, n_findings int")
