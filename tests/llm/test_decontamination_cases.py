"""Items and documents by hand: short items, few literal words, openers, clashes, shared windows; and re-parameterised copies."""

import random

import pytest

from loomspan.llm import decontamination


def found(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(a, b, **more).collect()}


def test_short_and_bare_items(spark):
    items = [(1, "What is the capital of France"), (2, "12 + 30 = 42"), (3, "yes"), (4, None), (5, "3 km 4 kg 5 lb 6 oz 7 mg")]
    docs = [
        (1, "He asked: what is the capital of Norway? Nobody knew it at all that day, and so on."),
        (2, "a sum such as 12 + 30 = 42 is easy"),
        (3, "another sum such as 12 + 31 = 43 is easy"),
        (4, "yes"), (5, None), (6, ""), (7, "take 3 km 4 kg 5 lb 6 oz 7 mg of it"), (8, "take 3 km 4 kg 9 lb 6 oz 7 mg of it"),
    ]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (7, 5)}
    assert not found(spark, docs, [(4, None), (3, "yes")]) and not found(spark, [(5, None)], items)


def test_openers_and_clashes(spark):
    item = "Tom has 3 apples and 5 pears in his green bag. Anna takes 2 of the apples and runs home to her mother. How many apples are left for Tom now?"
    docs = [
        (1, "Kim has 7 apples and 9 pears in his green bag. Lily takes 4 of the apples and runs home to her mother. How many apples are left for Kim now?"),
        (2, item.replace("3 apples", "4 apples").replace("5 pears", "4 pears")),  # two values become one
        (3, "Before. " + item.replace("Tom now", "Bob now") + " Behind."),  # one clash at the end
        (4, "Cats have 3 lives and 5 names in some green book. Dogs take 2 of the roads and run home to their mothers."),
    ]
    got = found(spark, docs, [(9, item)])
    assert set(got) == {(1, 9), (2, 9), (3, 9)} and got[3, 9]["longest_run"] >= 20


def test_shared_windows(spark, monkeypatch):
    """The words of the task stand in every item; a document with those alone holds none, one with an item holds that one."""
    monkeypatch.setattr(decontamination, "SHARED", 4)
    task = "read the following passage with care and then choose the best answer"
    rng = random.Random(3)
    own = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(20)]
    items = [(k, f"{task} {w}") for k, w in enumerate(own)] + [(100 + k, task) for k in range(6)]
    docs = [(1, f"x {task} y"), (2, f"so {task} {own[7]} end"), (3, own[9])]
    assert set(found(spark, docs, items)) == {(1, 100 + k) for k in range(6)} | {(2, 100 + k) for k in range(6)} | {(2, 7), (3, 9)}


def test_passage_of_many_items(spark):
    """Each of 70 items begins with one passage: a document with that alone holds over half of each, whatever their number."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = words(30)
    items = [(k, f"{passage} {words(12)}") for k in range(70)]
    assert set(found(spark, [(1, f"x {passage} y"), (2, passage[:60])], items)) == {(1, k) for k in range(70)}


def test_common_windows_lose_nothing(spark, monkeypatch):
    """Items of shared and own parts: windows that propose nothing change no row."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    shared = [words(n) for n in (9, 12, 15, 22)]
    part = lambda: rng.choice(shared) if rng.random() < 0.6 else words(rng.randint(2, 12))
    items = [(k, " ".join(part() for _ in range(rng.randint(1, 4)))) for k in range(40)]
    items += [(40 + k, items[k][1]) for k in range(5)]
    docs = [(k, " ".join(rng.choice([part(), rng.choice(items)[1]]) for _ in range(3))) for k in range(40)]
    monkeypatch.setattr(decontamination, "COMMON", 10**9)
    whole = found(spark, docs, items)
    monkeypatch.setattr(decontamination, "COMMON", 2)
    assert found(spark, docs, items) == whole and len(whole) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_changed_items(spark, seed):
    """Items with other numbers and names are found, and each only with its own item."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfghlmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("bcdfghlmnprst", k=3))
    name = lambda: word().capitalize()
    frames = [" ".join(word() if rng.random() < 0.75 else rng.choice(["#", "@"]) for _ in range(30)) for _ in range(60)]

    def filled(frame):
        return " ".join(str(rng.randint(2, 999)) if w == "#" else name() if w == "@" else w for w in frame.split())

    items = [(k, filled(f)) for k, f in enumerate(frames)]
    docs = [(k, " ".join(word() for _ in range(40)) + " " + filled(f) + " " + " ".join(word() for _ in range(40))) for k, f in enumerate(frames)]
    got = set(found(spark, docs, items))
    assert len(got & {(k, k) for k in range(60)}) >= 54 and not {(a, b) for a, b in got if a != b}
