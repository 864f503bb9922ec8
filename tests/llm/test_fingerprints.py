import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from clicktide.llm import fingerprints as fp


def mixed(text, *seeds):
    seed = 42
    for part in seeds:
        seed = xxhash.xxh64(part.encode(), seed).intdigest()
    return xxhash.xxh64(text.encode(), seed).intdigest()


def brute_vector(text):
    """The documented sum, piece by piece and field by field."""
    found, piece = [], ""
    for i, c in enumerate(text):
        piece += c
        if c == "\n" or (c == " " and i and text[i - 1] in ".!?"):
            found.append(piece)
            piece = ""
    found += [piece] if piece else []
    plain, fields = [0] * 5, [0] * 60
    for p in found:
        plain[0] += 1
        for k in range(4):
            plain[1 + k] = (plain[1 + k] + mixed(p, f"lane {k}")) % 2**60
        h = mixed(p, "fields")
        for j in range(20):
            for k in range(3):
                fields[3 * j + k] = (fields[3 * j + k] + (h >> (j + 20 * k) & 1)) % 2**20
    lanes = plain + [sum(fields[3 * j + k] << 20 * k for k in range(3)) for j in range(20)]
    return "".join(f"{x:015x}" for x in lanes)


def brute_likeness(a, b):
    lanes = [[int(s[i : i + 15], 16) for i in range(0, 375, 15)] for s in (a, b)]
    if a == b:
        return 1.0
    gap, total = lanes[0][0] - lanes[1][0], 0.0
    for x, y in zip(lanes[0][5:], lanes[1][5:]):
        for k in range(3):
            d = ((x >> 20 * k) - (y >> 20 * k) + 2**19) % 2**20 - 2**19
            total += (gap - 2 * d) ** 2
    return max(0.0, min(1.0, 1 - total / 60 / max(1, lanes[0][0] + lanes[1][0])))


def brute(rows):
    """Rows in order of (id, none first; hash); equal rows count once."""

    def key(row):
        h = xxhash.xxh64(row[1].encode(), 42).intdigest()
        return (row[0] is not None, row[0] or 0, h - 2**64 if h >= 2**63 else h)

    texts = [(i, t or "") for i, t in rows]
    order = sorted(set(texts), key=key)
    after = {r: order[(n + 1) % len(order)][1] for n, r in enumerate(order)}
    out = []
    for row in texts:
        text, n = row[1], len(row[1])
        edited = text[: n - n // 2] + after[row][: n // 2]
        a, b, c = brute_vector(text), brute_vector(edited), brute_vector(after[row])
        out.append((row[0], n, hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c)))
    return sorted(out, key=repr)


def compared(df):
    got = fp.compare_with_edit(df).withColumn("edited", F.sha2("edited", 256))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9


def test_equals_brute_force(spark, docs):
    rng = random.Random(4)
    words = "one two three four. five six! seven\n eight? nine. é日😀".split(" ")
    rows = [(i * 5, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(70)]
    rows += [(3, ""), (4, None), (7, "\n\n. . \n"), (8, "x" * 40_000 + ". y"), (9, "same"), (9, "same"), (9, "other. text"), (None, "no id. at all\n"), (None, "no id. at all\n")]
    same(compared(docs(rows)), brute(rows))


def test_single_and_empty_table(spark, docs):
    assert compared(docs([])) == []
    same(compared(docs([(1, "a. b\nc")])), brute([(1, "a. b\nc")]))


def test_insertion_deletion_and_order(spark, docs):
    texts = docs([(1, "a b. c d\ne f")]).select(
        fp.vector(F.lit("a b. c d\ne f\n")).alias("whole"), fp.vector(F.lit("e f\na b. c d\n")).alias("turned"),
        fp.vector(F.lit("c d\n")).alias("one"), fp.vector(F.lit("a b. e f\n")).alias("rest"),
        fp.vector(F.lit("a b. c d\ne g\n")).alias("other"),
    )
    row = texts.select(
        (F.col("whole") == F.col("turned")).alias("unordered"),
        (fp.add(F.col("rest"), F.col("one")) == F.col("whole")).alias("inserted"),
        (fp.subtract(F.col("whole"), F.col("one")) == F.col("rest")).alias("deleted"),
        (fp.subtract(fp.subtract(F.col("one"), F.col("whole")), F.col("one")) == fp.subtract(fp.vector(F.lit("")), F.col("whole"))).alias("wraps"),
        (F.col("whole") != F.col("other")).alias("differs"),
    ).first()
    assert all(row)


def test_likeness_follows_the_share_of_common_pieces(spark, docs):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(40):
        n, shared = 120, 3 * i
        pieces = [f"piece {rng.random()}\n" for _ in range(n)]
        other = pieces[:shared] + [f"piece {rng.random()}\n" for _ in range(n - shared)]
        rows.append((i, "".join(pieces) + "\x1f" + "".join(other)))
        truth[i] = shared / n
    both = docs(rows).select(
        "doc_id", fp.likeness(fp.vector(F.substring_index("text", "\x1f", 1)), fp.vector(F.substring_index("text", "\x1f", -1))).alias("near")
    )
    errors = [abs(r.near - truth[r.doc_id]) for r in both.collect()]
    assert sum(errors) / len(errors) < 0.12 and max(errors) < 0.45


def test_no_python_in_the_plan(spark, docs):
    plan = fp.compare_with_edit(docs([(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
