import random

from tidemark.llm import near_dup as N


def sets(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, similar=85):
    s = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(s[a] & s[b])
            if s[a] and s[b] and 100 * i >= similar * len(s[a] | s[b]):
                label[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    out = []
    for k, (d, _) in enumerate(rows):
        c = least.get(find(k)) if s[k] else d
        out.append((d, len(s[k]), c, d == c))
    return sorted(out, key=repr)


def corpus(seed=1, groups=6, size=40):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    shared = [word() for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([30, 120, 400]))]
        if g % 2:
            base += shared
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 40) + 3)):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t).title() if r.random() < 0.3 else "  ".join(t))
            if r.random() < 0.3:
                texts.append(texts[-1])
    texts += [" ".join(word() for _ in range(80)) for _ in range(60)]
    chain = [word() for _ in range(200)]  # each links to the next only
    for k in range(12):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    texts += ["a b", "A  b", "a b c", "", None, "\xa0", "one two three four five", " "]
    r.shuffle(texts)
    return [(3 * k % 1009, t) for k, t in enumerate(texts)]


def test_components_match_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(*x, "k", 7) for x in rows], "doc_id long, text string, key string, id int")
    got = sorted(map(tuple, N.report(d).collect()), key=repr)
    assert got == brute(rows)
    kept = N.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in brute(rows, 80) if x[3])


def test_collisions_asked_for():
    assert (N.matches_for(85), N.matches_for(80), N.matches_for(100)) == (15, 12, 32)


def test_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text"), (None, "a b c d e f"), (2, "A B c d e f"), (None, None), (None, "alone here"), (7, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, N.report(d).collect()), key=repr)
    want = [(5, 2, 2, False), (5, 2, 2, False), (5, 1, 5, True), (None, 2, 2, False), (2, 2, 2, True), (None, 0, None, True), (None, 1, None, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert got == sorted(want, key=repr)
    assert N.report(d.limit(0)).count() == 0


def test_hot_lists_in_blocks_and_a_group_that_mostly_does_not_link(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "w%d" % r.randrange(9000)
    shared, rows = [word() for _ in range(150)], []
    for k in range(160):  # similar to each other, but below the threshold
        rows.append((k, " ".join(shared + [word() for _ in range(40)])))
    for k in range(160, 240):  # near copies of one text
        w = shared + [str(i) for i in range(100)]
        w[r.randrange(150, 250)] = word()
        rows.append((k, " ".join(w)))
    rows += [(300, "long text of many words " * 40_000), (301, "long text of many words " * 40_000), (302, None), (302, "")]
    monkeypatch.setattr(N, "BLOCK", 16)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.report(d).collect()), key=repr) == brute(rows)
