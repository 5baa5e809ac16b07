import random

from quillspark.llm import near_dedup as N


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_rows_are_told_apart_by_id_and_text(make):
    rng = random.Random(1)
    base = prose(rng, 60)
    copy = [*base[:30], "other", *base[31:]]
    lone, other = " ".join(prose(rng, 40)), " ".join(prose(rng, 40))
    rows = [(1, " ".join(base)), (5, " ".join(copy)), (5, lone), (7, other), (7, other), (None, " ".join(base)), (None, None), (8, ""), (8, ""), (9, " ".join(reversed(base))), (9, " ".join(reversed(base)).upper())]
    got = sorted(((r["doc_id"], r["text"]) for r in N.dedup(make(rows), 2).collect()), key=repr)
    kept = [x for x in got if x[0] != 9]
    assert kept == sorted([(1, " ".join(base)), (5, lone), (7, other), (None, None), (8, ""), (8, "")], key=repr)
    assert len([x for x in got if x[0] == 9]) == 1
    # of null doc_ids alone one stays
    assert N.dedup(make([(None, lone), (None, lone), (None, lone + " x")]), 2).count() == 1


def sets_of(texts, width):
    out = {}
    for i, t in texts:
        w = t.split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def test_documents_of_one_template(make, monkeypatch):
    """Texts that share half their words with all others: all links of a brute force are kept, and few other pairs meet as full sets."""
    rng = random.Random(2)
    template = prose(rng, 45)
    texts = []
    for i in range(400):
        texts.append((i, " ".join(template + prose(rng, 45))))
    for i in range(400, 460):
        w = texts[rng.randrange(400)][1].split()
        w[60] = "changed"
        texts.append((i, " ".join(w)))
    sets = sets_of(texts, 2)
    label = {i: i for i, _ in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    for wanted in (N.BROADCAST_WANTED, -1):
        monkeypatch.setattr(N, "BROADCAST_WANTED", wanted)
        got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(make(texts), 2).collect()}
        assert got == {i: find(i) for i, _ in texts}
