"""Small literal frames and plain-Python answers to compare with."""

import math
from collections import defaultdict

from clicktide import schema as S

CLICK_COLUMNS = "id long, timestamp long, visitorid long, event string, itemid long, transactionid long"


def clicks(spark, rows):
    """Rows of (visitorid, event, itemid) in time order, one second apart."""
    full = [
        (i, 1_700_000_000_000 + 1000 * i, visitor, event, item, i if event == "transaction" else None)
        for i, (visitor, event, item) in enumerate(rows)
    ]
    return spark.createDataFrame(full, CLICK_COLUMNS)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def random_clicks(rng, n, visitors, items, hot=None):
    events = [*S.EVENT_TYPES, "signup"]
    made = []
    for _ in range(n):
        visitor = hot if hot is not None and rng.random() < 0.4 else rng.randrange(visitors)
        # low item ids are more popular
        item = min(int(rng.expovariate(4 / items)), items - 1)
        made.append((visitor, rng.choice(events), item))
    return made


def expected_recommendations(history, users, n):
    """Visitor -> list of (item, source), computed one visitor at a time."""
    rating, popularity = defaultdict(int), defaultdict(int)
    for visitor, event, item in history:
        popularity[item] += 1
        if event in S.EVENT_WEIGHTS:
            rating[visitor, item] += S.EVENT_WEIGHTS[event]
    vectors = defaultdict(dict)
    for (visitor, item), value in rating.items():
        vectors[item][visitor] = value

    def cosine(a, b):
        dot = sum(v * vectors[b].get(u, 0) for u, v in vectors[a].items())
        norms = [sum(v * v for v in vectors[x].values()) for x in (a, b)]
        return dot / math.sqrt(float(norms[0]) * float(norms[1]))

    near = {}
    for a in vectors:
        scored = [(-cosine(a, b), b) for b in vectors if b != a]
        near[a] = [b for s, b in sorted(scored) if s < 0][:n]
    ranking = sorted(popularity, key=lambda i: (-popularity[i], i))
    answer = {}
    for user in users:
        seen = sorted(i for (v, i) in rating if v == user)
        votes, first = defaultdict(int), {}
        for item in seen:
            for place, other in enumerate(near[item]):
                if other not in seen:
                    votes[other] += 1
                    first.setdefault(other, (item, place))
        best = sorted(votes, key=lambda i: (-votes[i], first[i]))[:n]
        rest = [i for i in ranking if i not in seen and i not in best][: n - len(best)]
        answer[user] = [(i, "similar") for i in best] + [(i, "popular") for i in rest]
    return answer
