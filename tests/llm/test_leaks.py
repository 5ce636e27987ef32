import random

from paperlake.llm.leaks import leaks, readings

WORDS = [f"w{i}" for i in range(40)] + ["naïve", "Røros"]


def brute(docs, items, shared=12):
    out = set()
    for i, t in items:
        words = readings(t)[-1] if t else []
        grams = {tuple(words[k : k + shared]) for k in range(len(words) - shared + 1)}
        for d, x in docs:
            if x and any(tuple(r[k : k + shared]) in grams for r in readings(x) for k in range(len(r) - shared + 1)):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(n, " ".join(rng.choices(WORDS, k=rng.choice([5, 20, 40])))) for n in range(30)] + [(90, None), (91, "")]
    docs = [(-1, None), (-2, "")]
    for n in range(150):
        item = items[n % 30][1].split()
        k = rng.choice([8, 11, 12, 13, 20])
        a = rng.randrange(max(1, len(item) - k))
        part = [f"**{w.upper()}**" if rng.random() < 0.1 else w for w in item[a : a + k]]
        docs.append((n, " ".join(rng.choices(WORDS, k=15)) + ",\n" + "  ".join(part) + ". " + " ".join(rng.choices(WORDS, k=15))))
    docs += docs[:5]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, words string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaks(d, e).collect()]
    assert sorted(got) == sorted(brute(docs, items))
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0


def test_line_end_hyphens(spark):
    item = "one two three four oxygen-uptake five six seven eight nine ten"
    docs = ["One two three fo-\nur oxygen-\nuptake five six seven eight nine ten", "one two three four oxygen uptake five six seven eight nine tenth"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [tuple(r) for r in leaks(d, e).collect()] == [(0, 1)]
