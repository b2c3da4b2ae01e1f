import os
import random

import pytest

pytest.importorskip("tracklane.llm")
from tracklane.llm.leakage import LeakConfig, Scanner, find_leaks, flat, words_at
from tracklane.llm.mojibake import GarbleConfig, find_garbled, segments
from tracklane.llm.packing import VOCABULARY, PackConfig, encoder, pack, plan_bins

DOCS = "doc_id bigint, text string, id string, n int, container string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


# packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_and_places_every_item_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 7, 50, 97])
    hist = {rng.randint(1, cap): rng.randint(1, 60) for _ in range(rng.randint(0, 25))}
    seen, used = {}, {}
    for n, a, b, k, first, at in plan_bins(hist, cap):
        seen.setdefault(n, []).append((a, b))
        for r in range(a, b):
            start = at + (r - a) % k * n
            used.setdefault(first + (r - a) // k, []).append((start, start + n))
    for n, count in hist.items():
        spans = sorted(seen[n])
        assert spans[0][0] == 0 and spans[-1][1] == count and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= cap and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert len(used) == best_fit([n for n, c in hist.items() for _ in range(c)], cap)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_pack_cuts_only_long_texts(spark):
    texts = [None, "", "one", "two words", "a b c d e f g h i j k l m n o p", "word " * 1000, "x", "x"]
    enc, cap = encoder(VOCABULARY), 8
    got = pack(docs(spark, texts), "doc_id", "text", PackConfig(capacity=cap, rank_block=2)).collect()
    use = {}
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        n = len(enc.encode_ordinary(t)) if t else 0
        assert sum(r["n_tokens"] for r in mine) == n and len(mine) == max(1, -(-n // cap))
        assert [r["start_token"] for r in mine] == [p * cap for p in range(len(mine))]
        for r in mine:
            if n:
                use.setdefault(r["container"], []).append((r["offset"], r["offset"] + r["n_tokens"]))
            else:
                assert r["container"] is None
    for spans in use.values():
        spans.sort()
        assert spans[-1][1] <= cap and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert pack(docs(spark, []), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_a_long_plan_is_joined_by_stretches(spark):
    texts = ["word " * (i % 7 + 1) for i in range(60)] + ["x " * 40]
    row = lambda r: (r["doc_id"], r["piece"], r["container"], r["offset"], r["n_tokens"])
    one, two = (sorted(map(row, pack(docs(spark, texts), "doc_id", "text", PackConfig(capacity=16, rank_block=4, broadcast_rows=n)).collect())) for n in (1000, 0))
    assert one == two and len(one) == 60 + -(-len(encoder(VOCABULARY).encode_ordinary(texts[-1])) // 16)


# leakage

ITEM = "The plain tower corrects the seed while a decoder joins ten distant protocols. The fragile receiver amplifies the cluster even if a tunnel trims idle runways. The rough receiver tightens every propeller after noon."
OTHER = "Each quiet harbour lowers a marker until seven brittle lanterns gather beneath that narrow granite bridge, and nobody counts their slow reflections before winter arrives again."
OPENING = "Complete the function so that all of the listed checks pass. "


def test_leaks_in_every_dress(spark):
    words = ITEM.split()
    changed = " ".join("changed" if i % 11 == 7 else w for i, w in enumerate(words))
    texts = [
        "intro\n" + ITEM + "\nend",
        ITEM.upper(),
        "\n".join("# * " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6)),
        "<p>" + ITEM.replace("the", "<b>the</b>") + "</p>",
        '{"source": ["' + ITEM.replace(". ", '.\\n", "\\n", "') + '"]}',
        changed,
        " ".join(words[: len(words) * 3 // 4]),
        " ".join(words[: len(words) // 3]),  # too little
        OPENING * 3,
        "The plain tower corrects the seed",
        None,
        "",
        ITEM + " filler " * 50 + OTHER,
        "filler " * 200_000 + ITEM,
        ITEM.replace("tower", "t\\u006fwer"),
    ]
    items = spark.createDataFrame([(1, OPENING + ITEM, "x"), (2, OPENING + OTHER, "x"), (3, None, "x"), (4, "", "x"), (5, "too short", "x")] + [(10 + i, OPENING, "x") for i in range(6)], "item_id bigint, text string, doc string")
    got = {}
    for r in find_leaks(docs(spark, texts), "doc_id", "text", items, "item_id", "text").collect():
        if r["item"] >= 10:
            assert r["doc"] == 8  # the opening as an item of its own, six times over
        else:
            got.setdefault(r["doc"], set()).add(r["item"])
            assert texts[r["doc"]][r["start_char"] : r["end_char"]].split()[-1].lower().rstrip('."]}</p>') in ("noon", "again", words[len(words) * 3 // 4 - 1].lower().rstrip("."))
    assert got == {i: {1} for i in (0, 1, 2, 3, 4, 5, 6, 13, 14)} | {12: {1, 2}}
    assert find_leaks(docs(spark, []), "doc_id", "text", items, "item_id", "text").count() == 0
    assert find_leaks(docs(spark, texts), "doc_id", "text", items.filter("false"), "item_id", "text").count() == 0
    every = find_leaks(docs(spark, texts), "doc_id", "text", items, "item_id", "text").filter("item >= 10").groupBy("item").count().collect()
    assert {r["item"]: r["count"] for r in every} == {10 + i: 3 for i in range(6)}  # each copy in the text is a passage
    blocks = find_leaks(docs(spark, texts), "doc_id", "text", items, "item_id", "text", LeakConfig(block_chars=100))
    assert {(r["doc"], r["item"]) for r in blocks.collect() if r["item"] < 10} == {(d, i) for d, s in got.items() for i in s}


@pytest.mark.parametrize("many", [6, 600])
def test_items_that_are_alike_are_all_found(many):
    same = Scanner([(i, ITEM) for i in range(many)], LeakConfig())
    assert {r[0] for r in same.find("before " + ITEM + " after")} == set(range(many))
    near = Scanner([(i, f"{ITEM} variant number {i}") for i in range(many)], LeakConfig())
    assert {r[0] for r in near.find("before " + ITEM + " after")} == set(range(many))


def test_short_and_changed_items():
    short = "seven brittle lanterns gather beneath"
    s = Scanner([(1, short), (2, short + " that narrow"), (3, "four words no more"), (4, ITEM)], LeakConfig())
    assert {r[0] for r in s.find("So " + short + " that wide bridge")} == {1}
    assert {r[0] for r in s.find("So " + short + " that narrow bridge")} == {1, 2}
    assert s.find("four words no more") == []
    words = ITEM.split()
    each = lambda n: " ".join("changed" if i % n == n - 1 else w for i, w in enumerate(words))
    assert {r[0] for r in s.find(each(7))} == {4}
    assert s.find(each(5)) == []  # no run of five is left: the docstring says so


def test_the_opening_alone_is_none_of_the_items_it_opens():
    s = Scanner([(i, OPENING + " ".join(ITEM.split()[i:] + ITEM.split()[:i])) for i in range(0, 30, 3)], LeakConfig())
    assert s.find(OPENING * 4) == []


def test_words_and_flat_agree():
    for t in ("Ünï cödé <b>bold</b> x\\ny", 'a_b-c "d\\u00e9f"', "\x1b[0;31mred\x1b[0m É", ""):
        assert flat(t).split() == words_at(t)[0]


def test_scanner_of_nothing():
    assert Scanner([], LeakConfig()).find("text") == [] == Scanner([(1, ITEM)], LeakConfig()).find("")


# garbled text

CLEAN = {
    "fr": "Déjà vu : la façade très complète déplace près du café où l’hélice éclaire même l’été après la forêt",
    "uk": "Якщо вимірювання прямує саме висота також ніж похибка між шлях який місяць якщо що човен",
    "pl": "Właśnie próbka powtórzy między śnieg także więc łódź mierzy większy świt żółw później źródło",
    "en": "He said “yes” – it’s 20 °C ± 3 µm…",
}


def corpus():
    rng = random.Random(0)
    out = []
    for _ in range(60):
        for t in CLEAN.values():
            w = t.split()
            rng.shuffle(w)
            out.append(" ".join(w))
    return out


def lenient(b, name):
    return "".join(bytes([x]).decode(name) if bytes([x]).decode(name, "ignore") else chr(x) for x in b)


def test_garbled_texts_are_found_and_restored(spark):
    fr, uk, pl = CLEAN["fr"], CLEAN["uk"], CLEAN["pl"]
    bad = [("plain words before " + lenient(fr.encode(), n) + " and after", fr) for n in ("cp1252", "latin-1", "mac_roman", "cp437")]
    bad += [(lenient(lenient(fr.encode(), "cp1252").encode(), "cp1252"), fr), (uk.encode("cp1251").decode("latin-1"), uk), (uk.encode("koi8_u").decode("cp1251"), uk), (lenient(pl.encode("cp1250"), "cp1252"), pl)]
    lost = fr.encode("utf-8").decode("ascii", "replace")
    clean = corpus() + [None, "", "ascii only", "Ã É Ü standing alone", "RÉSUMÉ’S RELAY", "é" * 50_000]
    texts = clean + [t for t, _ in bad] + [lost]
    found = {}
    for r in find_garbled(docs(spark, texts), "doc_id", "text", GarbleConfig(known_share=0.01, contamination=0.02)).collect():
        assert texts[r["doc"]][r["start_char"] : r["end_char"]] == r["garbled"]
        found.setdefault(r["doc"], []).append(r)
    assert sorted(found) == list(range(len(clean), len(texts)))
    for d, (text, want) in enumerate(bad, len(clean)):
        for r in sorted(found[d], key=lambda r: -r["start_char"]):
            text = text[: r["start_char"]] + r["restored"] + text[r["end_char"] :]
        assert want in text, (d, text)
    assert {r["kind"] for r in found[len(texts) - 1]} == {"lost"} and all(r["restored"] is None for r in found[len(texts) - 1])


def restored(texts, rows):
    out = dict(enumerate(texts))
    for r in sorted(rows, key=lambda r: -r["start_char"]):
        out[r["doc"]] = out[r["doc"]][: r["start_char"]] + (r["restored"] or "?") + out[r["doc"]][r["end_char"] :]
    return out


GEORGIAN = "ჩვენ ვზომავთ სიმაღლეს"


def test_what_the_corpus_does_not_know_is_restored_by_its_bytes(spark):
    """Emoji, and a script that is in no other text."""
    good = ["done \U0001f600 and \U0001f680", GEORGIAN, "sum ≈ ∑x"]
    bad = [lenient(t.encode(), n) for t in good for n in ("cp1252", "latin-1")]
    clean = corpus() + ["qualité\u00a0» et «\u00a0été\u00a0»…", "┌──┐ │x│ └──┘ ├┤", "Рік ії її сії", "naïve Ã alone", GEORGIAN]
    found = find_garbled(docs(spark, clean + bad), "doc_id", "text", GarbleConfig(known_share=0.01, contamination=0.02)).collect()
    assert {r["doc"] for r in found} == set(range(len(clean), len(clean) + len(bad)))
    fixed = restored(clean + bad, found)
    assert [fixed[len(clean) + i] for i in range(len(bad))] == [t for t in good for _ in range(2)]


@pytest.mark.parametrize("kind", ["utf8", "bytes"])
def test_garble_in_more_texts_than_are_allowed_for(spark, kind):
    """A share of garbled texts above the contamination, all alike in kind, and saved twice."""
    good = [t for t in corpus() if any(c in t for c in ("і" if kind == "bytes" else "é"))]
    bad = [(t.encode("cp1251").decode("latin-1") if kind == "bytes" else lenient(t.encode(), "cp1252")) for t in good[:8]] * 2
    clean = corpus()
    texts = clean + bad
    assert len(bad) / len(texts) > 0.06
    found = find_garbled(docs(spark, texts), "doc_id", "text", GarbleConfig(known_share=0.01, contamination=0.02)).collect()
    assert {r["doc"] for r in found} == set(range(len(clean), len(texts)))
    fixed = restored(texts, found)
    assert [fixed[len(clean) + i] for i in range(16)] == good[:8] * 2


def test_single_byte_garble_beside_a_utf8_one(spark):
    uk, fr = CLEAN["uk"], "Déjà"
    text = lenient(fr.encode(), "cp1252") + " " + uk.encode("cp1251").decode("latin-1")
    clean = corpus()
    found = find_garbled(docs(spark, [*clean, text]), "doc_id", "text", GarbleConfig(known_share=0.01, contamination=0.02)).collect()
    assert {r["kind"] for r in found} == {"utf8", "bytes"}
    assert restored([*clean, text], found)[len(clean)] == fr + " " + uk


def test_no_texts(spark):
    assert find_garbled(docs(spark, []), "doc_id", "text").count() == 0 == find_garbled(docs(spark, [None, ""]), "doc_id", "text").count()


def best_segments(at, cost, n):
    """Maximum-scoring segments by definition: take the best, then look left and right of it."""
    score = [1.0 if i in set(at) else -cost for i in range(n)]

    def solve(lo, hi):
        best = None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += score[j]
                if s > 0 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) < 1e-12 and (j - i) < best[2] - best[1])):
                    best = s, i, j
        return [] if best is None else solve(lo, best[1]) + [(best[1], best[2])] + solve(best[2] + 1, hi)

    return solve(0, n)


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximum_scoring_ones(seed):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(40), rng.randint(0, 15)))
    assert segments(at, 0.25) == best_segments(at, 0.25, 40)
