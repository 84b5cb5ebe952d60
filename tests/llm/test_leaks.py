import random

from caseloom.llm import leaks

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ban", "del", "fir", "gom", "hul", "jat")]


def passage(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(9)) * 0 for _ in range(n)]


def run(spark, docs, items, **k):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, doc_id string")
    return sorted(tuple(r) for r in leaks.leaked_items(d, i, **k).collect())


def test_words_ignore_what_makes_no_difference():
    plain = leaks.words_of("Die Straße führt zum Labor, sagte l'agent.")
    for t in ("DIE STRASSE FÜHRT ZUM LABOR, SAGTE L’AGENT", "<p>Die <b>Stra</b>ße fu\u0308hrt</p> zum La\u00adbor sagte l&#39;agent", "> Die Straße führt zum La-\r\n> bor; *sagte* **l'agent**", "Die\u200b Straße\nführt zum\u00a0Labor \u2014 sagte l'agent"):
        assert leaks.words_of(t) == plain, t
    assert leaks.words_of(None) == [] and leaks.words_of("") == []


def test_whole_part_and_edited(spark):
    rng = random.Random(3)
    items = [(k, " ".join(passage(rng, 50))) for k in range(8)]
    fill = lambda: " ".join(passage(rng, 80))
    edited = items[2][1].split()
    for at in (7, 19, 31, 43):
        edited[at] = "other"
    dropped = [w for k, w in enumerate(items[3][1].split()) if k % 12 != 11]
    added = [x for k, w in enumerate(items[4][1].split()) for x in ([w, "um"] if k % 12 == 5 else [w])]
    docs = [
        (0, fill() + " " + items[0][1].upper() + " " + fill()), (1, fill() + " " + " ".join(items[1][1].split()[8:40]) + " " + fill()), (2, " ".join(edited) + fill()), (3, fill() + " ".join(dropped)),
        (4, fill() + " " + " ".join(added)), (5, fill() + " " + " ".join(items[5][1].split()[:12]) + " " + fill()), (6, fill()), (7, items[6][1] + " " + fill() + " " + items[7][1]), (8, None), (9, ""), (0, fill() + " " + items[0][1]),
    ]
    want = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 6), (7, 7)]
    assert run(spark, docs, items + [items[0], (50, None), (51, ""), (None, "x")]) == want


def test_empty_tables_and_long_text(spark):
    rng = random.Random(1)
    item = " ".join(passage(rng, 60))
    assert run(spark, [], [(1, item)]) == [] and run(spark, [(1, item)], []) == []
    assert run(spark, [(1, " ".join(passage(rng, 60_000)) + " " + item)], [(1, item)]) == [(1, 1)]


def test_winnowing_guarantee():
    import numpy as np

    rng = np.random.default_rng(0)
    need = leaks.SHINGLE + leaks.WINDOW - 1
    for _ in range(200):
        shared = rng.integers(0, 2**63, need).astype("uint64")
        a, b = (np.concatenate([rng.integers(0, 2**63, 30).astype("uint64"), shared, rng.integers(0, 2**63, 30).astype("uint64")]) for _ in range(2))
        prints = [set(leaks.shingles(x)[leaks.winnow(leaks.shingles(x))].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]


def test_edits_near_the_ends_lose_no_passage():
    import numpy as np

    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 2**63, n).astype("uint64")
    for size in (40, 41, 60, 80):
        item, long = leaks.Vocabulary().hashes([f"w{k}" for k in range(size)]), -(-size * 6 // 10)
        text = np.concatenate([some(50), item[5 : 5 + long], some(50)])
        text[[50 + long - 8, 50 + long - 5]] = some(2)
        assert leaks.contains(text, item)
        for _ in range(60):
            first = rng.integers(size - long + 1)
            words = [[w] for w in item[first : first + long]]
            for at in rng.choice(long, long // 10, replace=False):
                words[at] = [[], list(some(1)), [words[at][0], *some(1)]][rng.integers(3)]
            text = np.concatenate([some(50), np.array([x for w in words for x in w], "uint64"), some(50)])
            assert leaks.contains(text, item)
        assert not leaks.contains(np.concatenate([some(50), item[: size * 4 // 10], some(50)]), item)


def test_fuller_and_many_other_places_hide_no_passage():
    import numpy as np

    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 2**63, n).astype("uint64")
    item = leaks.Vocabulary().hashes([f"w{k}" for k in range(60)])
    passage = item[10:46].copy()
    passage[[8, 17, 26]] = some(3)
    # Seventy places hold less than half of the item but more shingles than the edited passage has.
    parts = [x for _ in range(70) for x in (item[:24], some(200))]
    assert not leaks.contains(np.concatenate(parts), item)
    assert leaks.contains(np.concatenate([*parts, passage, some(50)]), item)
    # One place repeats many times over a few words: far fuller, and no passage either.
    assert leaks.contains(np.concatenate([np.tile(np.concatenate([item[:6], item[:6]]), 9), some(200), passage]), item)


def test_edited_passages_share_a_fingerprint():
    """Any stretch of 60 percent with one word in ten edited shares a fingerprint, wherever the edits lie."""
    import numpy as np

    rng = np.random.default_rng(9)
    some = lambda n: rng.integers(0, 2**63, n).astype("uint64")
    prints = lambda x: set(leaks.shingles(x)[leaks.winnow(leaks.shingles(x))].tolist())
    for size in (20, 25, 33, 40, 86, 300):
        item = some(size)
        held_out = prints(item)
        long = -(-size * 6 // 10)
        for _ in range(100):
            first = rng.integers(size - long + 1)
            text = item[first : first + long].copy()
            text[rng.choice(long, long // 10, replace=False)] = some(long // 10)
            assert len(held_out & prints(np.concatenate([some(30), text, some(30)]))) >= leaks.least_shared(size)


def test_several_texts_of_one_id_and_many_decoys(spark):
    rng = random.Random(5)
    item = passage(rng, 100)
    decoys = " ".join(" ".join(item[:29] + passage(rng, 120) + item[71:] + passage(rng, 120)) for _ in range(80))
    real = item[20:80]
    for at in (5, 15, 25, 35, 45, 55):
        real[at] = "other"
    docs = [(1, decoys), (2, decoys + " " + " ".join(real)), (3, "nothing here at all of the kind"), (3, " ".join(item))]
    assert run(spark, docs, [(1, " ".join(item)), (2, " ".join(passage(rng, 40))), (2, " ".join(item[10:90]))]) == [(2, 1), (2, 2), (3, 1), (3, 2)]
