"""Text read in a wrong character encoding, and its restoration (problem 10).

One pass counts in how many texts each pair of adjacent characters occurs, if one of
them is not ASCII. The mutual information of a pair is taken after a share of the
texts is allowed for contamination, so garbled pairs, which always come together but
in few texts, are not probable by that alone. Pairs that would be far more frequent
in another encoding, or that are built as UTF-8 is, are suspect however frequent. A
second pass scores the pairs of each text, isolates its runs of improbable and suspect
pairs as maximum-scoring segments and tries inverse mappings inside those runs only:

* bytes of UTF-8 read in a single-byte encoding: the inverse must be valid UTF-8 (again
  and again, as text may be garbled twice) of characters that the corpus knows, or,
  where it knows them not, of enough bytes to be no chance and of one script with
  what stands beside them; where a run's pairs are probable, what is restored must be
  as frequent;
* one single-byte encoding read as another: the pairs of the inverse must be known and
  several times as frequent in the corpus as those of the run;
* replacement characters: garbled beyond restoration.

Frequencies are compared, not held against a line, so a kind of garble may be in many
texts as long as the characters it stands for are in several times as many. What is
needed is kept for pairs in at least ``known_share`` of the texts; rarer ones count as
half of that.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.session import cut


@dataclass(frozen=True)
class GarbleConfig:
    contamination: float = 0.05  # share of texts in which a garbled pair may occur
    known_share: float = 0.001  # of texts: pairs and characters in fewer count as half as frequent as that
    least_information: float = -3.0  # of a probable pair
    gap_cost: float = 0.25  # per probable pair inside a run
    better_gap_cost: float = 0.15  # per pair that no encoding betters inside a run where single-byte inverses are tried
    times: float = 3.0  # as frequent the pairs of a single-byte inverse must be (geometric mean), and a pair's inverse to make it suspect
    rescue: float = 0.25  # share of the pairs of a single-byte inverse that may be unknown
    least_pairs: int = 4  # pairs that a single-byte inverse needs
    least_bytes: int = 3  # of UTF-8 sequences that restore characters the corpus does not know
    block_chars: int = 2_000_000  # characters held as arrays at a time
    # How text is commonly misread. Tried in this order.
    misread_utf8: tuple[str, ...] = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "iso8859_2", "koi8_u")
    misread_bytes: tuple[tuple[str, str], ...] = (
        ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("koi8_u", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_u"), ("cp866", "cp1251"),
        ("cp1251", "cp866"), ("cp1252", "koi8_u"), ("latin-1", "koi8_u"), ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("cp1252", "iso8859_2"),
        ("latin-1", "iso8859_2"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"),
        ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "iso8859_5"), ("mac_cyrillic", "cp1251"),
    )


@dataclass
class Model:
    """What the corpus knows: keys of pairs, sorted, with the log of the number of texts they are in and whether they are probable; the same of characters."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.empty(0))
    probable: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    chars: dict[str, float] = field(default_factory=dict)
    floor: float = 0.0  # the log that stands for what is rarer than all this

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return i, self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def frequency(self, keys: np.ndarray) -> np.ndarray:
        i, known = self._at(keys)
        return np.where(known, self.logs[i], self.floor) if len(self.keys) else np.full(len(keys), self.floor)

    def is_probable(self, keys: np.ndarray) -> np.ndarray:
        i, known = self._at(keys)
        return known & self.probable[i] if len(self.keys) else known


_BITS = 21  # of a code point
_LOW = (1 << _BITS) - 1
_SINGLE = 1 << 2 * _BITS  # added to the key of a character by itself


def _fold_table() -> np.ndarray:
    """Lower case of each code point; those of case lie below 0x20000."""
    out = np.arange(0x110000, dtype=np.int64)
    out[:0x20000] = [ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(0x20000)))]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pairs(codes: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of each adjacent pair with a character that is not ASCII, letters folded."""
    wide = codes > 127
    at = np.flatnonzero(wide[:-1] | wide[1:])
    return at, (fold[codes[at]] << _BITS) | fold[codes[at + 1]]


def _blocks(texts: list[str | None], limit: int) -> Iterator[tuple[list[int], str]]:
    """Numbers of texts that are not ASCII, joined by NUL, in blocks of about ``limit`` characters."""
    at, size = [], 0
    for i, t in enumerate(texts):
        if t and not t.isascii():
            at.append(i)
            size += len(t)
            if size >= limit:
                yield at, "\0".join(texts[j] for j in at)
                at, size = [], 0
    if at:
        yield at, "\0".join(texts[j] for j in at)


def _starts(texts: list[str], at: list[int]) -> np.ndarray:
    return np.cumsum([0] + [len(texts[i]) + 1 for i in at])


_TEXTS = -1  # the key under which texts themselves are counted


def _count(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    fold = _fold_table()
    for b in batches:
        texts = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([_TEXTS]), pa.array([b.num_rows])], ["k", "n"])
        for at, joined in _blocks(texts, limit):
            codes = _codes(joined)
            pos, key = _pairs(codes, fold)
            wide = np.flatnonzero(codes > 127)
            pos, key = np.concatenate([pos, wide]), np.concatenate([key, _SINGLE | fold[codes[wide]]])
            kinds, kind = np.unique(key, return_inverse=True)
            doc = np.searchsorted(_starts(texts, at), pos, side="right")
            once = np.unique(doc.astype(np.int64) * len(kinds) + kind)
            n = np.bincount(once % len(kinds), minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["k", "n"])


def corpus_model(docs: DataFrame, text: str, cfg: GarbleConfig = GarbleConfig()) -> Model:
    """Frequency of the pairs and characters found in at least ``known_share`` of the texts.

    What is gathered is bounded: a text of m distinct pairs counts towards m of them,
    so there are at most (mean m) / known_share rows, however many texts.
    """
    rows = docs.filter(F.col(text) != "").select(F.col(text).alias("t"))
    counts = cut(rows.mapInArrow(partial(_count, limit=cfg.block_chars), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")))
    texts = counts.filter(F.col("k") == _TEXTS).first()
    if texts is None:
        return Model()
    total, counts = texts["n"], counts.filter(F.col("k") != _TEXTS)
    got = counts.filter(F.col("n") >= max(2, cfg.known_share * total)).toPandas().sort_values("k")
    k, n = got["k"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    single = k >= _SINGLE
    share = dict(zip((k[single] & _LOW).tolist(), n[single].tolist(), strict=True))
    pk, pn = k[~single], n[~single]
    a = np.array([share.get(int(x), total) for x in pk >> _BITS], float)
    b = np.array([share.get(int(x), total) for x in pk & _LOW], float)  # ASCII characters are in nearly all texts
    left = pn - cfg.contamination * total
    with np.errstate(divide="ignore", invalid="ignore"):
        information = np.log(np.where(left > 0, left, 0) * total / (a * b))
    floor = float(np.log(max(2, cfg.known_share * total) / 2))
    return Model(pk, np.log(pn), information > cfg.least_information, {chr(c): float(np.log(m)) for c, m in share.items()}, floor)


def segments(at: list[int], cost: float) -> list[tuple[int, int]]:
    """Maximum-scoring segments (first, last position) of pairs scored 1 at ``at`` and -cost elsewhere, in one pass."""
    out: list[list[float]] = []  # left sum, right sum, first, last
    total, last, base = 0.0, None, 0  # segments before ``base`` are final
    for p in at:
        if last is not None:
            total -= cost * (p - last - 1)
        seg = [total, total + 1.0, p, p]
        total, last = total + 1.0, p
        while True:
            j = len(out) - 1
            while j >= base and out[j][0] >= seg[0]:
                j -= 1
            if j < base:  # the sum has never been lower: nothing before can be joined any more
                base = len(out)
            if j < base or out[j][1] >= seg[1]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(int(s[2]), int(s[3])) for s in out]


def _table(name: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of their number, as lenient readers have it."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _script(c: str) -> str:
    """The first word of a letter's name, which is its script; scripts written together are one. Empty for what is no letter."""
    if not c.isalpha():
        return ""
    first = unicodedata.name(c, "UNNAMED").split()[0]
    return "CJK" if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO") else "LATIN" if first in ("MODIFIER", "FEMININE", "MASCULINE") else first


def _bytes_beyond_ascii(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) - sum(c.isascii() for c in text)


class Restorer:
    def __init__(self, model: Model, cfg: GarbleConfig) -> None:
        self.model, self.cfg, self.fold = model, cfg, _fold_table()
        self.to_byte = {n: _table(n) for n in {*cfg.misread_utf8, *(w for w, _ in cfg.misread_bytes)}}
        self.back = {}  # of each single-byte misreading, the right code point of each wrong one; 0 where there is none
        for wrong, right in cfg.misread_bytes:
            char = {b: c for c, b in _table(right).items()}
            to = np.zeros(0x10000, np.int64)
            for c, b in self.to_byte[wrong].items():
                to[ord(c)] = ord(char[b])
            to[:128] = np.arange(128)
            self.back[wrong, right] = to
        self.part = np.zeros(0x110000, np.uint8)  # which readings make a character the first byte of a sequence (1) or a later one (2)
        for name in cfg.misread_utf8:
            for c, b in self.to_byte[name].items():
                if b > 127:
                    self.part[ord(c)] |= 2 if b < 0xC0 else 1

    def suspects(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair: whether it is improbable or built as UTF-8 is, and whether another single-byte encoding makes it far more frequent."""
        kinds, kind = np.unique(key, return_inverse=True)
        a, b = kinds >> _BITS, kinds & _LOW
        own, best = self.model.frequency(kinds), np.full(len(kinds), -np.inf)
        basic = (a < 0x10000) & (b < 0x10000)
        a, b = np.where(basic, a, 0), np.where(basic, b, 0)
        for to in self.back.values():
            x, y = to[a], to[b]
            ok = basic & ((x > 0) | (a == 0)) & ((y > 0) | (b == 0)) & ((x != a) | (y != b))
            best = np.maximum(best, np.where(ok, self.model.frequency((self.fold[x] << _BITS) | self.fold[y]), -np.inf))
        better = best - own > np.log(self.cfg.times)
        utf8 = ((self.part[kinds >> _BITS] & 1) > 0) & ((self.part[kinds & _LOW] & 2) > 0)
        return (~self.model.is_probable(kinds) | utf8 | better)[kind], better[kind]

    def frequencies(self, text: str) -> np.ndarray:
        """Of the pairs of a text that hold a character beyond ASCII, blanks around it."""
        return self.model.frequency(_pairs(_codes(" " + text + " "), self.fold)[1])

    def fits(self, text: str, run: str, before: str, after: str) -> bool:
        """Whether ``run``, which is not probable, or no more so than ``text``, may stand for ``text`` between two characters."""
        wide = [c.lower() for c in text if not c.isascii()]
        known = [self.model.chars.get(c, self.model.floor) for c in wide]
        if all(c in self.model.chars for c in wide):
            key = _pairs(_codes(run), self.fold)[1]
            return not self.model.is_probable(key).all() or np.mean(known) >= self.model.frequency(key).mean()
        if _bytes_beyond_ascii(text) < self.cfg.least_bytes or any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in text):
            return False
        return len({s for c in (before + text + after) if (s := _script(c))}) <= 1

    def from_utf8(self, run: str, before: str, after: str) -> str | None:
        """The text whose UTF-8 bytes were read as ``run``, if there is one that fits between its neighbours."""
        for name in self.cfg.misread_utf8:
            table = self.to_byte[name]
            try:
                text = bytes([table[c] for c in run]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text != run and (again := self.from_utf8(text, before, after) if len(text) > 1 else None) is not None:
                return again
            if text != run and self.fits(text, run, before, after):
                return text
        return None

    def from_bytes(self, run: str) -> str | None:
        """The text in another single-byte encoding, if its pairs are known and several times as frequent as those of ``run``."""
        codes, own = _codes(run), self.frequencies(run)
        if len(own) < self.cfg.least_pairs or codes.max() > 0xFFFF:
            return None
        best = None
        for to in self.back.values():
            right = np.where(codes < 128, codes, to[codes])
            if not right.all():
                continue
            text = "".join(map(chr, right.tolist()))
            got = self.frequencies(text)
            unknown, gain = int((got <= self.model.floor).sum()), got.mean() - own.mean() if len(got) else -np.inf
            if unknown <= self.cfg.rescue * len(got) and len(got) - unknown >= self.cfg.least_pairs and gain > np.log(self.cfg.times) and (best is None or gain > best[0]):
                best = gain, text
        return best and best[1]

    @staticmethod
    def words(text: str, first: int, last: int, lo: int, hi: int) -> tuple[int, int]:
        """The pairs from first to last with the rest of the words they are in (letters and what is beyond ASCII), within lo and hi."""
        a, b = max(first, lo), min(last + 2, hi)
        while a > lo and (text[a - 1].isalpha() or not text[a - 1].isascii()) and not text[a - 1].isspace():
            a -= 1
        while b < hi and (text[b].isalpha() or not text[b].isascii()) and not text[b].isspace():
            b += 1
        return a, b

    def in_bytes(self, text: str, better: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, str, str | None]]:
        """Runs of text[lo:hi] that another single-byte encoding explains, around the pairs that one betters."""
        for first, last in segments([p for p in better if lo <= p and p + 1 < hi], self.cfg.better_gap_cost):
            if last + 1 < lo:
                continue
            i, j = self.words(text, first, last, lo, hi)
            if j > i and (good := self.from_bytes(text[i:j])) is not None:
                yield i, j, "bytes", good
            lo = max(lo, j)

    def repair(self, text: str, at: list[int], better: list[int]) -> list[tuple[int, int, str, str | None]]:
        """(first, last + 1, kind, restored) of each garbled run among the suspect pairs at ``at``; ``better``: those that a single-byte encoding betters."""
        out, done = [], 0
        for first, last in segments(at, self.cfg.gap_cost):
            a, b = self.words(text, first, last, done, len(text))
            if b <= a:
                continue
            done, i, open_ = b, a, a
            here = [p for p in better[np.searchsorted(better, a) : np.searchsorted(better, b)]] if better else []
            while i < b:  # runs beyond ASCII; single-byte inverses are tried between those found
                if text[i].isascii():
                    i += 1
                    continue
                j = i
                while j < b and not text[j].isascii():
                    j += 1
                run, found = text[i:j], None
                if "\ufffd" in run:
                    found = i, j, "lost", None
                elif j - i > 1 and (good := self.from_utf8(run, text[i - 1 : i], text[j : j + 1])) is not None:
                    found = i, j, "utf8", good
                if found:
                    out += [*self.in_bytes(text, here, open_, i), found]
                    open_ = j
                i = j
            out += self.in_bytes(text, here, open_, b)
        return out


def _repair(batches: Iterator[pa.RecordBatch], model: Model, cfg: GarbleConfig) -> Iterator[pa.RecordBatch]:
    r = Restorer(model, cfg)
    for b in batches:
        texts, rows = b.column(1).to_pylist(), []
        for at, joined in _blocks(texts, cfg.block_chars):
            pos, key = _pairs(_codes(joined), r.fold)
            suspect, better = r.suspects(key)
            pos, better = pos[suspect], better[suspect]
            start = _starts(texts, at)
            doc = np.searchsorted(start, pos, side="right") - 1
            inside = (pos >= start[doc]) & (pos + 1 < start[doc + 1] - 1)  # not across the border of two texts
            pos, doc, better = pos[inside], doc[inside], better[inside]
            for d in np.unique(doc):
                i, own = at[d], slice(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
                here = pos[own] - start[d]
                rows += [(b.column(0)[i].as_py(), *x, texts[i][x[0] : x[1]]) for x in r.repair(texts[i], here.tolist(), here[better[own]].tolist())]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["doc", "start_char", "end_char", "kind", "restored", "garbled"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def find_garbled(docs: DataFrame, doc_id: str, text: str, cfg: GarbleConfig = GarbleConfig()) -> DataFrame:
    """(doc, start_char, end_char, kind, restored, garbled) of each garbled run; restored is null where the original is lost.

    Null, empty and ASCII texts hold none; repeated texts have their rows each; no
    texts give no rows. Other columns are ignored. Not found are single-byte garbles of
    fewer than ``least_pairs`` pairs, of languages in under ``known_share`` of the texts,
    or in over 1 / ``times`` as many texts as the language itself.
    """
    model = corpus_model(docs, text, cfg)
    rows = docs.filter(F.col(text) != "").select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    schema = "doc bigint, start_char bigint, end_char bigint, kind string, restored string, garbled string"
    return rows.mapInArrow(partial(_repair, model=model, cfg=cfg), schema)
