import random

from caseloom.llm import levels

EASY = "cat dog box red sun hat map bag cup bus".split()
MEDIUM = "picture folder compare review export device report archive second message".split()
HARD = "notwithstanding heterogeneity epistemological reconciliation admissibility stochastic provenance necessitating infrastructures jurisdictional".split()


def text(rng, level, n=70):
    pool, size = {"easy": (EASY, 5), "medium": (MEDIUM, 13), "hard": (HARD, 40)}[level]
    words = [rng.choice(pool + ["the", "and", "of"]) for _ in range(n)]
    return " ".join(" ".join(words[i : i + size]).capitalize() + "." for i in range(0, n, size))


def corpus(seed):
    rng = random.Random(seed)
    truth = {i: rng.choice(list(levels.LEVELS)) for i in range(150)}
    docs = [(i, text(rng, l)) for i, l in truth.items()]
    labels = [(i, truth[i] if r != "bad" else rng.choice(list(levels.LEVELS)), r) for i in range(90) for r in (["a", "bad"] if i % 4 == 0 else ["b"])]
    return truth, docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, level string")
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, level string, reader string, text string")
    return {r.doc_id: r.level for r in levels.reading_levels(d, l).collect()}


def test_held_out_accuracy_with_a_careless_reader(spark):
    truth, docs, labels = corpus(1)
    got = run(spark, docs, labels + labels[:5])
    held_out = range(90, 150)
    assert sum(got[i] == truth[i] for i in held_out) >= 57


def test_only_running_prose_has_a_level(spark):
    truth, docs, labels = corpus(2)
    odd = [
        (1000, None), (1001, ""), (1002, "short note."), (1003, "\n".join(f"2025-01-0{i % 9}T10:00:00Z INFO id={i} ab{i}cd rc=0" for i in range(90))),
        (1004, "id,size,md5\n" + "\n".join(f"{i},{i * 7},{'ab' * 16}" for i in range(90))), (1005, "\n".join(f"{i:08x}  " + "ee dd 0a ff " * 4 for i in range(90))),
        (1006, docs[0][1].replace(". ", ".\nmd5 0123456789abcdef0123456789abcdef\n/cases/a/b.jpg\n- ")), (1007, docs[0][1] + " " + ("the cat and the dog. " * 20_000)), (None, docs[0][1]),
    ]
    got = run(spark, docs + odd, labels + [(None, "easy", "a"), (1, None, "a"), (2, "odd", None), (5, "easy", None)])
    assert not {1000, 1001, 1002, 1003, 1004, 1005} & set(got) and got[1006] == got[0] and 1007 in got and None not in got


def test_nothing_to_learn_from(spark):
    truth, docs, labels = corpus(3)
    assert run(spark, docs, []) == {} and run(spark, [], labels) == {}
    assert run(spark, docs, [(1, "none", "a"), (9999, "easy", "a")]) == {}
