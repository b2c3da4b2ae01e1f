"""Evaluation passages inside training texts (problem 9).

Every run of five words of every test item, shared with other items or not, is a
pattern of one Aho-Corasick automaton over normalised words (of items under eight
words the whole item is). Each text is normalised and scanned once. Where patterns
of one item come close together and the words around them could make up half of the
item, item and text are aligned there, which allows for changed, added and lost words;
the item is found if the aligned words are at least half of its own. Opening
instructions that many items share point to all of them, but count only for items in
which such runs make up the words needed; others must show runs of their own. Positions
are mapped back to the original text.

Not found: a passage in which no ``least_runs`` runs of five words are left as they
were (every fifth word changed, say; a shared opening does not count); an item of under
eight words that is not there whole; and items of under
``least_words`` words, which are short phrases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeakConfig:
    run: int = 5  # words of a pattern
    whole_under: int = 8  # items of fewer words are one pattern
    least_words: int = 5  # items of fewer words are never looked for
    shared_by: int = 5  # items; of a run in more of them not every item counts as the owner
    least_runs: int = 4  # different runs of an item that must lie close together; of short items a quarter of their runs
    least_share: float = 0.5  # of the item's words that the passage must hold
    mismatch: float = 0.5
    text_gap: float = 0.3
    item_gap: float = 0.5
    slack: int = 40  # words beyond an item's length that its passage may take up
    at_once: int = 64  # alignments
    block_chars: int = 2_000_000  # of items to one automaton (about 0.1 KB a character); more items are scanned for in several passes


# Escapes, terminal codes and tags become blanks of the same length, so offsets stay.
_NOISE = re.compile(r"\\+[nrtf](?![a-z]*\{)|\\u001b\[[0-9;]*m|\x1b\[[0-9;]*m|</?[a-zA-Z][^<>\n]{0,60}>|&(?:nbsp|amp|lt|gt|quot|#\d+);|\xad")
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f]|\\u[0-9a-fA-F]{4}(?<!\\u001b))+")
_SPLIT = re.compile(r"(?:[^\w\u0300-\u036f]|_)+")
_ASCII = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 for b in range(256))  # lower case, blanks for what is in no word
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _quiet(text: str) -> str:
    return _NOISE.sub(_blank, text) if "\\" in text or "<" in text or "\x1b" in text or "&" in text or "\xad" in text else text


def _fold(word: str) -> str:
    if "\\" in word:
        word = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), word)
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()


def words_at(text: str) -> tuple[list[str], list[int], list[int]]:
    """Normalised words of a text with where each begins and ends in it."""
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(_quiet(text))]
    return [_fold(w) for w, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


def flat(text: str) -> str:
    """The words of a text, blank before and after each."""
    text = _quiet(text)
    if "\\u" in text and _ESCAPE.search(text):
        return " " + " ".join(_fold(m.group()) for m in _WORD.finditer(text)) + " "
    if text.isascii():
        return " " + " ".join(text.encode().translate(_ASCII).decode().split()) + " "
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return " " + " ".join(_SPLIT.sub(" ", text.lower()).split()) + " "


def align(items: list[np.ndarray], texts: list[np.ndarray], cfg: LeakConfig = LeakConfig()) -> list[tuple[int, int, int]]:
    """Best local alignment of each item with its text, as word lists: (words matched, first and last position in the text).

    All pairs advance together, an item's word a step; pairs are taken from the longest item on, so those still at work come first.
    """
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    k, n = len(items), max(map(len, texts))
    text = np.full((k, n), -1)
    for row, i in enumerate(order):
        text[row, : len(texts[i])] = texts[i]
    lengths = np.array([len(items[i]) for i in order])
    where = np.arange(n + 1, dtype=np.int32)
    ramp = cfg.text_gap * where
    score, hits, begin = np.zeros((k, n + 1)), np.zeros((k, n + 1), np.int32), np.tile(where, (k, 1))
    best, found, starts = np.zeros(k), np.zeros((k, 3), np.int64), (np.arange(k) * (n + 1))[:, None]
    for step in range(lengths[0]):
        live = int((lengths > step).sum())
        word = np.array([items[i][step] for i in order[:live]])
        same = text[:live] == word[:, None]
        diag = score[:live, :-1] + np.where(same, 1.0, -cfg.mismatch)
        up = score[:live, 1:] - cfg.item_gap
        use = diag >= up
        top = np.where(use, diag, up)
        some = top > 0
        lifted, h, b = np.zeros((live, n + 1)), np.zeros((live, n + 1), np.int32), np.zeros((live, n + 1), np.int32)
        np.maximum(top, 0.0, out=lifted[:, 1:])
        lifted += ramp
        h[:, 1:] = np.where(use, hits[:live, :-1] + same, hits[:live, 1:]) * some
        b[:, 1:] = np.where(some, np.where(use, begin[:live, :-1], begin[:live, 1:]), where[1:])
        run = np.maximum.accumulate(lifted, axis=1)
        src = np.maximum.accumulate(where * (lifted >= run), axis=1) + starts[:live]
        score, hits, begin = run - ramp, h.ravel()[src], b.ravel()[src]
        j, row = score.argmax(1), np.arange(live)
        better = score[row, j] > best[:live]
        row, j = row[better], j[better]
        best[row] = score[row, j]
        found[row] = np.stack([hits[row, j], begin[row, j], j - 1], 1)
    out = [(0, 0, 0)] * k
    for row, i in enumerate(order):
        out[i] = tuple(found[row].tolist())
    return out


@dataclass
class _Item:
    """Items of the same words: their ids, their words as codes, and those sorted with how often each occurs."""

    ids: list[int]
    words: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray
    least: int  # runs
    need: float  # words
    own: np.ndarray  # of each run, whether it alone tells the item: always so unless runs that many items share make up less than the words needed

    def shown_by(self, runs: np.ndarray) -> bool:
        return len(runs) >= self.least and len(set(runs[self.own[runs]].tolist())) >= self.least

    def could_hold(self, text: np.ndarray) -> bool:
        """Whether the words of a text, in whatever order, could make up the needed ones."""
        at = np.minimum(np.searchsorted(self.kinds, text), len(self.kinds) - 1)
        seen = np.bincount(at[self.kinds[at] == text], minlength=len(self.kinds))
        return np.minimum(seen, self.counts).sum() >= self.need


class Scanner:
    """The automaton over items (id, text), and what finds them in a text."""

    def __init__(self, items: list[tuple[int, str]], cfg: LeakConfig) -> None:
        import ahocorasick

        self.cfg, self.codes, self.items, owners, same = cfg, {}, [], {}, {}
        for k, text in items:
            words = tuple(flat(text or "").split())
            if len(words) >= cfg.least_words:
                same.setdefault(words, []).append(k)
        for words, ids in same.items():
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words]  # 0 stands for words of no item
            short = len(words) < cfg.whole_under
            size, need = (len(words), len(words)) if short else (cfg.run, cfg.least_share * len(words))
            runs = len(words) - size + 1
            for i in range(runs):
                owners.setdefault(tuple(coded[i : i + size]), []).append((len(self.items), i))
            kinds, counts = np.unique(coded, return_counts=True)
            self.items.append(_Item(ids, np.array(coded), kinds, counts, min(cfg.least_runs, -(-runs // 4)), need, np.ones(runs, bool)))
        shared: dict[int, list[tuple[int, int]]] = {}
        for run, own in owners.items():
            if len({k for k, _ in own}) > cfg.shared_by:
                for k, i in own:
                    shared.setdefault(k, []).append((i, i + len(run)))
        for k, spans in shared.items():
            if len({w for a, b in spans for w in range(a, b)}) < self.items[k].need:
                self.items[k].own[[a for a, _ in spans]] = False
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, run in enumerate(owners):
            self.auto.add_word(run, n)
        self.first = np.cumsum([0, *map(len, owners.values())])  # of the owners of each run, in one array
        self.owner = np.array([o for own in owners.values() for o in own], np.int32).reshape(-1, 2)
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()

    def _coded(self, words: list[str]) -> list[int]:
        get = self.codes.get
        return [get(w, 0) for w in words]

    def _seeds(self, coded: list[int]) -> np.ndarray:
        """(item, position of the run's last word in the text, number of the run in the item) in that order."""
        hits = list(self.auto.iter(tuple(coded)))
        if not hits:
            return self.owner[:0]
        hits = np.array(hits, np.int64)
        many = self.first[hits[:, 1] + 1] - self.first[hits[:, 1]]
        at = np.repeat(self.first[hits[:, 1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own = self.owner[at]
        seeds = np.stack([own[:, 0], np.repeat(hits[:, 0], many), own[:, 1]], 1)
        return seeds[np.lexsort((seeds[:, 2], seeds[:, 1], seeds[:, 0]))]

    def _groups(self, seeds: np.ndarray) -> Iterator[tuple[_Item, np.ndarray]]:
        """Items with the seeds of each place where enough of their runs lie close together."""
        if not len(seeds):
            return
        reach = np.array([2 * len(x.words) + self.cfg.slack for x in self.items])
        new = (np.diff(seeds[:, 0]) != 0) | (np.diff(seeds[:, 1]) > reach[seeds[1:, 0]])
        begin = np.flatnonzero(np.r_[True, new])
        for a, b in zip(begin, np.r_[begin[1:], len(seeds)], strict=True):
            item = self.items[seeds[a, 0]]
            if item.shown_by(seeds[a:b, 2]):
                yield item, seeds[a:b, 1:]

    def _passages(self, texts: dict[int, list[int]]) -> dict[int, list[tuple[_Item, int, int, int]]]:
        """Of coded texts under their numbers (item, words matched, first and last word) of each passage, none of one item overlapping.

        Places to look at are gathered over all texts, so that many are aligned at once.
        """
        cfg, found, todo, kept = self.cfg, {}, [], {}
        for d, coded in texts.items():
            for item, own in self._groups(self._seeds(coded)):
                if d not in kept:
                    kept[d] = np.array(coded)
                begin = own[:, 0] - own[:, 1]  # where the item's first run would end
                todo.append((d, item, own, max(0, int(begin.min()) - cfg.run - cfg.slack), int(begin.max()) + len(item.words) + cfg.slack))
        while todo:
            fit = []
            for d, item, own, lo, hi in todo:
                here = own[np.searchsorted(own[:, 0], lo) : np.searchsorted(own[:, 0], hi), 1]
                if item.shown_by(here) and item.could_hold(kept[d][lo:hi]):
                    fit.append((d, item, own, lo, hi))
            fit.sort(key=lambda t: (len(t[1].words), t[4] - t[3]))  # alike in size, so little is padded
            todo = []
            for i in range(0, len(fit), cfg.at_once):
                part = fit[i : i + cfg.at_once]
                aligned = align([t[1].words for t in part], [kept[t[0]][t[3] : t[4]] for t in part], cfg)
                for (d, item, own, lo, hi), (hits, a, b) in zip(part, aligned, strict=True):
                    if hits >= item.need:
                        found.setdefault(d, []).append((item, hits, lo + a, lo + b))
                        todo += [(d, item, own, lo, lo + a), (d, item, own, lo + b + 1, hi)]
        return found

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """(item, share of its words, first and last character + 1) of every passage of an item in each text."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        if self.empty:
            return out
        coded = {d: self._coded(flat(t).split()) for d, t in enumerate(texts) if t}
        found = self._passages(coded)
        placed = {d: words_at(texts[d]) for d in found}
        # where folding changed the borders of words, they are counted as placed
        other = {d: self._coded(placed[d][0]) for d in found if len(placed[d][0]) != len(coded[d])}
        found = {d: f for d, f in found.items() if d not in other} | self._passages(other)
        for d, passages in found.items():
            _, begin, end = placed[d]
            out[d] = [(k, hits / len(item.words), begin[a], end[b]) for item, hits, a, b in passages for k in item.ids]
        return out

    def find(self, text: str) -> list[tuple[int, float, int, int]]:
        return self.find_all([text])[0]


TEXT_CHARS = 4_000_000


class Items:
    """Items as sent to the executors; the automaton is built once by each worker process that reads the broadcast."""

    def __init__(self, items: list[tuple[int, str]], cfg: LeakConfig) -> None:
        self.items, self.cfg, self.built = items, cfg, None

    def scanner(self) -> Scanner:
        if self.built is None:
            self.built = Scanner(self.items, self.cfg)
        return self.built


def _scan(batches: Iterator[pa.RecordBatch], items: Broadcast[Items]) -> Iterator[pa.RecordBatch]:
    scanner = items.value.scanner()
    for b in batches:
        rows, begin = [], 0
        while begin < b.num_rows:  # texts of about TEXT_CHARS at a time
            some, size = [], 0
            while begin + len(some) < b.num_rows and (not some or size < TEXT_CHARS):
                some.append(b.column(1)[begin + len(some)].as_py())
                size += len(some[-1])
            for i, hits in enumerate(scanner.find_all(some), begin):
                rows += [(b.column(0)[i].as_py(), *r) for r in hits]
            begin += len(some)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc", "item", "share", "start_char", "end_char"])


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc, item, share, start_char, end_char) of every passage of an item in each text.

    Items are a test set, not a corpus: they are gathered in blocks of
    ``block_chars``, each block one pass over the texts, and broadcast: a size bound
    that holds however many items there are. Items of the same words are found
    together, each under its own id. Null and empty texts hold nothing; repeated
    texts have their rows each; no items or no texts give no rows. Other columns are ignored.
    """
    out, block, size = None, [], 0
    rows = docs.filter(F.col(text) != "").select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    schema = "doc bigint, item bigint, share double, start_char bigint, end_char bigint"
    sent = docs.sparkSession.sparkContext.broadcast
    scan = lambda b: rows.mapInArrow(partial(_scan, items=sent(Items(b, cfg))), schema)
    test_set = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("k"), F.col(item_text).alias("t")).orderBy("k")
    for r in test_set.toLocalIterator():
        if block and size + len(r["t"]) > cfg.block_chars:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block, size = [], 0
        block.append((r["k"], r["t"]))
        size += len(r["t"])
    last = scan(block)
    return last if out is None else out.unionByName(last)
