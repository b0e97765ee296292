"""Template residue, filler, error pages and script notices in texts.

Two multi-pattern automata: one holds the phrases of error pages, fillers and script-required
notices in several languages, the other the delimiters of template fields. A text is cut into units
(lines and their sentences). The matches in a unit cover some of its words; a unit that they cover
nearly all of stands in place of content, a sentence that only mentions such a phrase doesn't. Unfilled fields are
found between their delimiters; one that is quoted or named as a field (in a manual, say) doesn't count.
The words of such units and fields over all words of the document are its coverage, and a document
is excluded from a least coverage on.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sutur.llm import residue_phrases as data

#: A document is excluded from this share of words in residue on: one residue line in an ordinary text of a few pages does, one word in a book doesn't.
LEAST_DOCUMENT_COVERAGE = 0.002
#: A unit is residue from this share of covered words on; errors that happen to other things too need more, fillers made of plain words at least three words.
LEAST_COVERAGE = 0.7
LEAST_DUMMY_COVERAGE = 0.8
LEAST_THING_COVERAGE = 0.8
_LEAST_LETTERS = re.compile(r"[^\W\d_]")
_KEYBOARD = re.compile(r"(?:asdf|sdfg|dfgh|qwerty|qwer|wert|zxcv|xcvb|hjkl|lkjh|poiu|uiop|jkl|ty)+\Z")
_CROSSES = re.compile(r"x{2,}\Z")
_MARKERS = re.compile(r"[{$%<\[#@_«(&]")
_NAMED = re.compile(r"(?:\b(?:field|variable|macro|placeholder|pattern|key|tag|token|config|block|element)\s*[`'\"‘’“”]?|[`'\"‘“]|\\\w+)\Z", re.IGNORECASE)
_NAMED_AFTER = re.compile(r"[`'\"’”]|\s*کی جگہ")
_PLAIN_NAME = re.compile(r"[^\W_][\w.\- ]*\Z")
_IDENTIFIER = re.compile(r"[^\W\d_]{2,}\w*(?:[_.\-][^\W\d_]{2,}\w*)+\Z|[a-z]{2,}[A-Z][a-zA-Z]+\Z")
_CAPITALS = re.compile(r"[A-Z]{3,}\Z")
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤⁦-⁩﻿]")
_MARKS = re.compile(r"[̀-ͯؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ]")
_FOLD = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ة": "ہ", "ۃ": "ہ", "أ": "ا", "إ": "ا", "ئ": "ئ", "’": "'", "‘": "'"})
_DIGIT_RUN = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_IDEOGRAPH = re.compile(r"([\u3040-\u30ff\u3400-\u9fff])")
_SENTENCE = re.compile(r"(?<=[.!?;؟۔।])\s+|[。！？\n]")


def _plain(text: str) -> str:
    """Lower case, digit runs as 0, one form of look-alike letters, no marks, no invisible characters; ideographs and kana stand alone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _IDEOGRAPH.sub(r" \1 ", _MARKS.sub("", text).translate(_FOLD))
    return _DIGIT_RUN.sub("0", text.casefold().replace("'", ""))


def _words(text: str) -> list[str]:
    return _WORD.findall(_plain(text))


def _phrases(block: str) -> list[str]:
    found = (" ".join(_words(p)) for line in block.strip().splitlines() for p in line.split("|"))
    return [p for p in found if p]


class ResidueMatcher:
    """The automata and the rules; one per worker."""

    def __init__(self) -> None:
        self._dummy = set(_words(data.DUMMY_WORDS))
        self._number = set(_words(data.NUMBER_WORDS))
        self._empty = set(data.EMPTY_VALUES)
        self._function = set(data.FUNCTION_WORDS.split())
        self._html = set(data.HTML_ELEMENTS.split())
        self._names = set(_phrases(data.FIELD_NAMES))
        self._fill_in = set(_phrases(data.FILL_IN))
        self._all, self._strong = ahocorasick.Automaton(), ahocorasick.Automaton()
        kinds = [("", data.GLUE), ("thing", data.THINGS), ("of a thing", data.ERRORS_OF_THINGS), *[("error", block) for block in data.ERRORS.values()], ("script", data.SCRIPTS), ("filler", data.FILLERS), ("lorem", data.LOREM_WORDS.replace(" ", "|"))]
        for kind, block in kinds:
            for phrase in _phrases(block):
                self._all.add_word(f" {phrase} ", (len(phrase) + 2, kind))
                if kind not in ("", "thing"):
                    self._strong.add_word(f" {phrase} ", kind)
        self._all.make_automaton()
        self._strong.make_automaton()
        self._pairs = [(pair, True) for pair in data.STRONG_DELIMITERS] + [(pair, False) for pair in data.WEAK_DELIMITERS]
        roles: dict[str, tuple[list[int], list[int]]] = {"\n": ([], [])}
        for number, ((opening, closing), _) in enumerate(self._pairs):
            roles.setdefault(opening, ([], []))[0].append(number)
            roles.setdefault(closing, ([], []))[1].append(number)
        self._delimiters = ahocorasick.Automaton()
        for delimiter, (opens, closes) in roles.items():
            self._delimiters.add_word(delimiter, (len(delimiter), opens, closes))
        self._delimiters.make_automaton()

    def _is_field(self, pair: int, inner: str, before: str) -> bool:
        """Whether what stands between two delimiters is an unfilled field."""
        (opening, closing), strong = self._pairs[pair]
        inner = inner.strip(" =-_{}%\t")
        if not _LEAST_LETTERS.search(inner):
            return False
        if strong:
            return opening != closing or bool(_PLAIN_NAME.match(inner))
        if before[-1:].isalnum() or not _PLAIN_NAME.match(inner.replace("ُ", "")):
            return False
        if opening == "<" and inner.lower().split(" ")[0] in self._html:
            return False
        words = _words(inner)
        name = " ".join(words)
        if opening not in ("(", "«") and (name in self._names or _IDENTIFIER.match(inner)):
            return True
        if opening in ("%", "$", "__"):
            return bool(_CAPITALS.match(inner))
        ends = [n for n in range(1, min(4, len(words))) if " ".join(words[-n:]) in self._fill_in]
        begins = [n for n in range(1, min(4, len(words))) if " ".join(words[:n]) in self._fill_in]
        if opening == "(":
            return any(" ".join(words[:-n]) in self._names for n in ends)
        return len(words) <= 8 and bool(ends or (begins and opening != "«"))

    def field_spans(self, text: str) -> list[tuple[int, int]]:
        """Places of unfilled template fields that are neither quoted nor named as fields; each lies within a line."""
        found: list[tuple[int, int]] = []
        opened: dict[int, tuple[int, int]] = {}
        for end, (size, opens, closes) in self._delimiters.iter_long(text):
            begin = end - size + 1
            if not opens and not closes:
                opened.clear()
                continue
            closed = False
            for pair in closes:
                start, inside = opened.get(pair, (-1, -1))
                if start >= 0 and self._is_field(pair, text[inside:begin], text[max(0, start - 1) : start]):
                    if not _NAMED.search(text[max(0, start - 24) : start]) and not _NAMED_AFTER.match(text, end + 1):
                        found.append((start, end + 1))
                    closed = True
                    break
            if closed:
                opened.clear()
                continue
            for pair in closes:
                opened.pop(pair, None)
            for pair in opens:
                opened[pair] = (begin, end + 1)
        return found

    def fields(self, text: str) -> int:
        """Number of unfilled template fields."""
        return len(self.field_spans(text))

    def _is_dummy(self, word: str) -> bool:
        return word in self._dummy or word == "0" or bool(_CROSSES.match(word)) or (len(word) > 3 and bool(_KEYBOARD.match(word)))

    def _mostly_plain(self, words: list[str]) -> bool:
        """Whether words that alone make residue may be enough of the unit; stops once too many others came."""
        if words[0] in self._empty:
            return True
        least, left = max(2, 0.5 * len(words)), len(words)
        for word in words:
            if left < least:
                return False
            left -= not (self._is_dummy(word) or word in self._number or word in self._empty)
        return left >= least

    def unit(self, words: list[str]) -> str:
        """Kind of residue of a unit, empty if none."""
        joined = f" {' '.join(words)} "
        covered = bytearray(len(joined))
        kinds: dict[str, int] = {}
        for end, (size, kind) in self._all.iter(joined):
            begin = end - size + 2  # without the blanks at both ends
            covered[begin:end] = b"\x01" * (end - begin)
            if kind:
                kinds[kind] = kinds.get(kind, 0) + 1
        at, plain, own, numbers, empty, hit = 1, 0, 0, 0, 0, 0
        total = sum(w not in self._function for w in words) or len(words)
        every = total == len(words)
        for word in words:
            dummy = self._is_dummy(word)
            plain += dummy
            own += dummy and word != "0"
            numbers += word in self._number
            empty += word in self._empty
            hit += (every or word not in self._function) and bool(covered[at] or dummy)
            at += len(word) + 1
        lorem, thing, of_thing = (kinds.pop(k, 0) for k in ("lorem", "thing", "of a thing"))
        if lorem >= 3 and lorem >= 0.6 * len(words):
            return "filler"
        if kinds and hit >= LEAST_COVERAGE * total:
            return max(kinds, key=lambda k: (kinds[k], k))
        if of_thing and (thing or len(words) <= 4) and hit >= LEAST_THING_COVERAGE * total:
            return "error"
        if own >= 3 and plain + numbers >= LEAST_DUMMY_COVERAGE * len(words):
            return "filler"
        if empty >= 2 and empty >= 0.5 * len(words):
            return "template"
        return ""

    def judge(self, text: str | None) -> tuple[list[str], float]:
        """Kinds of residue found in a text, and the share of its words that stand in residue."""
        if not text or text.isspace():
            return [], 0.0
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii():
            text = _INVISIBLE.sub("", text)
        kinds, inside, fields = set(), 0, 0
        if _MARKERS.search(text):
            pieces, last = [], 0
            for begin, end in self.field_spans(text):
                fields += max(1, len(_words(text[begin:end])))
                pieces += [text[last:begin], " "]
                last = end
            if fields:
                kinds.add("template")
                text = "".join([*pieces, text[last:]])
            if "[object object]" in text.lower():
                kinds.add("template")
                fields += 2
            text = _TAG.sub(lambda m: " " if m.group().strip("</>").split(" ")[0].lower() in self._html else m.group(), text)
        units = [words for unit in _SENTENCE.split(_plain(text)) if (words := _WORD.findall(unit))]
        total = sum(map(len, units)) + fields
        flat = f" {' '.join(w for u in units for w in u)} "
        suspect = next(self._strong.iter(flat), None) is not None
        for words in units:
            if not suspect and not self._mostly_plain(words):
                continue
            kind = self.unit(words)
            if kind:
                kinds.add(kind)
                inside += len(words)
            elif len(words) > 2 and words[0] in self._empty and words[2] in self._empty:  # a heading that was filled with nothing, before content
                kinds.add("template")
                inside += 3
        return sorted(kinds), (inside + fields) / total if total else 0.0

    def found(self, text: str | None, least: float = LEAST_DOCUMENT_COVERAGE) -> bool:
        """Whether a text is excluded."""
        kinds, coverage = self.judge(text)
        return bool(kinds) and coverage >= least


@lru_cache(maxsize=1)
def _matcher() -> ResidueMatcher:
    return ResidueMatcher()


def judge_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_coverage: float = LEAST_DOCUMENT_COVERAGE) -> DataFrame:
    """(id, kinds array<string>, coverage double, excluded boolean) of every row; no shuffle, whole texts.

    Excluded are documents with residue that covers at least ``least_coverage`` of their words. Null,
    empty and blank texts have no residue. Repeated rows are judged each. Only the two named columns are read.
    """
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _matcher().judge
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([k for k, _ in found], type=pa.list_(pa.string())),
                    pa.array([c for _, c in found], type=pa.float64()),
                    pa.array([bool(k) and c >= least_coverage for k, c in found], type=pa.bool_()),
                ],
                names=[id_column, "kinds", "coverage", "excluded"],
            )

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {id_type}, kinds array<string>, coverage double, excluded boolean")
