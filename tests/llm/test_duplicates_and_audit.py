"""MinHash groups, filter audit and fill-in-middle against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pergament.llm import fill_middle, filter_audit, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k=2):
    words = WORD.findall(lowered(text))
    return {" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def groups(rows):
    """Smallest reachable id of each row of (id, text), links by exact similarity."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    inverted = defaultdict(list)
    for i, x in enumerate(sets):
        for s in x:
            inverted[s].append(i)
    for i, x in enumerate(sets):
        for j, n in Counter(j for s in x for j in inverted[s] if j < i).items():
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n) and label[i] != label[j]:
                label = [label[j] if v == label[i] else v for v in label]
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[label[i]] = min(best.get(label[i], doc), doc)
    return [(doc, len(x), best.get(label[i]) if x else doc) for i, ((doc, _), x) in enumerate(zip(rows, sets))]


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def wanted(rows):
    return Counter((d, n, c, d == c) for d, n, c in groups(rows))


# ---- op 11


def test_minhash_on_odd_rows(corpus, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert found(minhash.cluster(corpus)) == wanted(rows)
    assert minhash.cluster(no_rows).count() == 0


@pytest.mark.parametrize("most,hashes", [(minhash.MOST, minhash.HASHES), (3, 400)])
def test_minhash_equals_brute_force(spark, monkeypatch, most, hashes):
    """Isolated pairs around the threshold, loose groups, copies, chains, a passage that all share; cells whole and in blocks."""
    monkeypatch.setattr(minhash, "MOST", most)
    monkeypatch.setattr(minhash, "HASHES", hashes)
    rng = np.random.default_rng(3)
    rows, word = [], lambda: f"w{rng.integers(10**9)}"
    for size in (5, 6, 10, 30, 80, 200):
        for changed in (0.03, 0.07, 0.09, 0.11, 0.13, 0.2):
            base = [word() for _ in range(size)]
            other = [word() if rng.random() < changed else w for w in base]
            rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((base, other))]
    base = [word() for _ in range(60)]
    for _ in range(60):  # a loose group: members differ from the base, hardly linked with each other
        rows.append((len(rows), " ".join(word() if rng.random() < 0.06 else w for w in base)))
    for _ in range(40):
        rows.append((len(rows), " ".join([word() for _ in range(9)] + base)))
    chain = [word() for _ in range(40)]
    for k in range(30):
        rows.append((len(rows), " ".join(chain)))
        chain[k % 40] = word()
    copy = " ".join(word() for _ in range(25))
    rows += [(len(rows) + k, copy if k % 2 else copy.upper()) for k in range(50)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(minhash.cluster(df)) == wanted(rows)


def test_signatures_agree_as_often_as_sets(spark):
    rng, orders, k = np.random.default_rng(5), minhash.orders(), 400
    agreed = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        y = np.r_[x[: 8 * k // 9], rng.integers(0, 1 << 63, k - 8 * k // 9, dtype=np.uint64)]
        agreed.append(int((minhash.signature(np.unique(x), orders) == minhash.signature(np.unique(y), orders)).sum()))
    assert abs(np.mean(agreed) / minhash.COORDINATES - 0.8**minhash.LEAST) < 0.02 and min(agreed) >= minhash.MATCHES


# ---- op 12


def audit_plain(rows, labels):
    """Apply all orders to rows (doc_id, text, source), one by one."""
    out, low = {}, {}
    for doc, text, _ in rows:
        if doc is not None:
            low[text or ""] = min(low.get(text or "", doc), doc)
    fails = []
    for doc, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails.append((source or "", f | {"E": doc is not None and doc > low[text]}, labels.get(doc, (False, False))))
    parts = sorted({p for p, _, _ in fails})
    for part in parts:
        own, shapley = [(f, says) for p, f, says in fails if p == part], Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, name in enumerate(order):
                gone = [i for i in left if own[i][0][name]]
                failing = [i for i in range(len(own)) if own[i][0][name]]
                left = [i for i in left if i not in set(gone)]
                alone = sum(1 for i in failing if sum(own[i][0].values()) == 1)
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(failing) - len(gone), alone, sum(own[i][1][0] for i in gone), sum(own[i][1][1] for i in gone), name]
                shapley[name] += len(gone)
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_filter_audit(spark, corpus, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (1_005, 1, 1), (None, 1, 1), (-5, None, None)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS n", "3 AS good")
    says = {1: (True, False), 2: (False, True), 1_005: (True, True)}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in corpus.collect()]
    assert audited(filter_audit.audit(corpus, labels)) == audit_plain(rows, says)
    assert filter_audit.audit(no_rows, labels).count() == 0
    assert audited(filter_audit.audit(corpus, labels.where("false"))) == audit_plain(rows, {})


@pytest.mark.parametrize("held", [filter_audit.PART_BYTES, 2_000])
def test_duplicates_in_ranges(spark, monkeypatch, held):
    """Copies far apart, texts that begin alike, one that begins another, ids in falling order."""
    monkeypatch.setattr(filter_audit, "PART_BYTES", held)
    rng = np.random.default_rng(2)
    stem = "".join(rng.choice(list("ab é"), 700))
    texts = ["", "a", "aa", "ab", stem, *(stem[:k] for k in range(0, 700, 23)), *(stem + c for c in "abcé"), *(stem[:300] + str(k) for k in range(60))]
    rows = [(int(i), texts[rng.integers(len(texts))], "s") for i in range(600, 0, -1)] + [(i, stem + "z", None) for i in (9, 9, 8, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    got = Counter()
    for r in filter_audit.masks(df, parts=7).collect():
        got[r["doc_id"], bool(r["mask"] & filter_audit.DUPLICATE)] += r["n"]
    low = {}
    for doc, text, _ in rows:
        low[text] = min(low.get(text, doc), doc)
    assert got == Counter((doc, doc > low[text]) for doc, text, _ in rows)


def test_prefix_weights_cut_what_is_heavy(spark):
    rows = [(k, "same beginning " + "x" * 300 + str(k)) for k in range(50)] + [(50 + k, f"{k} other") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'' AS part")
    parts, heavy = filter_audit.heavy_prefixes(docs, 8)
    assert parts == 8 and all(len(level) == 1 for level in heavy)
    prefixes = {r["prefix"] for r in filter_audit.read_rows(docs, heavy).collect()}
    assert len([p for p in prefixes if p.startswith("same")]) == 50


# ---- op 13


def fim_plain(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text)), text
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, n, form, a, b - a, sha(out), sha(text)), out


@pytest.mark.parametrize("units", [fill_middle.UNITS, 7])
def test_fill_middle(spark, corpus, no_rows, units):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()] + [(k, f"x{k} <{'PSM'[k % 3]}" + ">" * (k % 2) + "é€😀" * (k % 9)) for k in range(2_000, 2_060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if units < 100:
        df = df.where("coalesce(length(text), 0) < 20000")
        rows = [r for r in rows if len(r[1] or "") < 20_000]
    want = [fim_plain(*r) for r in rows]
    columns = "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    assert Counter(tuple(r) for r in fill_middle.digests(df, units).select(*columns).collect()) == Counter(w for w, _ in want)
    stored = fill_middle.store(df, units)
    outputs = fill_middle.transform(stored, units)
    assert Counter((r["doc_id"], r["text"]) for r in fill_middle.texts(outputs).collect()) == Counter((w[0], out) for w, out in want)
    assert Counter((r["doc_id"], r["text"]) for r in fill_middle.texts(fill_middle.restore(outputs, units)).collect()) == Counter((d, t or "") for d, t in rows)
    assert fill_middle.digests(no_rows).count() == 0


def test_cuts_touch_only_their_frames():
    text = ("0123456789" * 4 + "äöü€😀") * 50
    frames = fill_middle.text_frames(text.encode(), 64)
    assert frames.units == len(text) and frames.ends == [*range(64, len(text), 64), len(text)]
    opened, unpack = [], frames.unpack
    frames.unpack = lambda f: opened.append(f) or unpack(f)
    assert b"".join(frames.stream(130, 140)).decode() == text[130:140] and len(opened) == 1
    for a, b in ((0, 0), (0, 64), (63, 65), (64, 128), (5, len(text)), (len(text), len(text))):
        assert b"".join(frames.stream(a, b)).decode() == text[a:b]
    again = fill_middle.framed(frames.stream(), 50)
    assert b"".join(again.stream()).decode() == text and again.ends[0] == 50


def test_markers_are_found_across_frames():
    for units in (1, 2, 3, 4, 50):
        for at in range(12):
            data = "é" * at + "<S<S>" + "<M>" + "x" * 5
            frames = fill_middle.text_frames(data.encode(), units)
            assert frames.find(b"<S>") == at + 2 and frames.find(b"<M>", at + 5) == at + 5 and frames.find(b"<P>") == -1
    with pytest.raises(ValueError):
        list(fill_middle.restored(fill_middle.text_frames(b"<P>ab<S>c"), "psm"))
