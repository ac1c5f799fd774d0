"""Each operator against a brute-force version on a small table with the awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrloom.llm import bpe, chat, decontaminate, packing, pii, simhash, sketch, suffix_dedup, token_counts, toxicity
from attrloom.llm.encoder import Encoder, encoder, pieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids string, parts string, key long, row long"


def prose(rng, n):
    return " ".join("".join(rng.choice(("an", "the", "re", "ti", "on", "é", "ß", "st")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 5, 40, 120, 400, 2500)]
    shared = prose(rng, 70)
    near = base[3].split(" ")
    near[60] = "changed"
    out = [None, "", " ", "a", "\n\n", "x  \n y", *base, base[3], base[3], " ".join(near), base[2] + shared, shared + base[4][:900], shared,
           "aaaa" * 300, "Mail me: a.b-c@mail.example.org, 10.2.33.254 +1 (974) 555-3436 or 4111 1111 1111 1111.", "é 你好 \U0001f600 'll 12345 x" * 3]
    return list(enumerate(out)) + [(3, "a"), (None, base[2]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "f", "i", "p", 7, 8) for i, t in texts], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def expected_removals(texts, length):
    data = [(t or "").encode() for _, t in texts]
    count = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - length + 1):
            if count[d[k:k + length]] > 1:
                mask[k:k + length] = True
        out.append((len(d), int(mask.sum()), sha(np.frombuffer(d, np.uint8)[~mask].tobytes())))
    return out


@pytest.mark.parametrize(("length", "gram", "group_runs"), [(200, 32, 1 << 16), (60, 12, 1 << 16), (60, 12, 1)])
def test_repeated_bytes(docs, texts, length, gram, group_runs):
    got = suffix_dedup.remove_repeats(docs, length, gram, 3, group_runs).collect()
    rows = [(r.n_bytes, sum(s.end - s.start for s in r.removed), sha(bytes(r.kept))) for r in got]
    assert sorted(rows) == sorted(expected_removals(texts, length))
    assert all(a.end < b.start for r in got for a, b in zip(r.removed, r.removed[1:]))


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    rng = random.Random(2)
    part = prose(rng, 60)
    rows = [(0, prose(rng, 300) + part + prose(rng, 90)), (1, prose(rng, 200) + part)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, 12, 2).collect()
    assert sorted((r.n_bytes, sum(s.end - s.start for s in r.removed), sha(bytes(r.kept))) for r in got) == sorted(expected_removals(rows, 60))


def test_levels_merge_and_are_dropped(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    index = suffix_dedup.SuffixIndex(spark, 60, 12, 2)
    plain = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    for k in range(4):
        index.add(plain.filter(F.col("doc") % 4 == k))
    assert [rank for rank, _ in index.levels] == [2]
    index.close()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_byte_pairs(docs, texts):
    fold = bpe.Fold()
    got = bpe.encode(docs, fold).select("doc_id", "ids", fold.decode(F.col("ids")).alias("back")).collect()
    library = encoder().library
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.back)) for r in got), key=str) == sorted(want, key=str)


def test_the_fold_equals_the_library(spark, texts):
    words = sorted({p for _, t in texts for p in pieces(t or "")} | {"  x\u2003\u3000y", "\u1680z", "don't", "\x1c\x85"})
    rows = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    got = {r.w: list(r.ids) for r in rows.select("w", bpe.Fold().piece(F.col("w")).alias("ids")).collect()}
    assert got == {w: encoder().library.encode_ordinary(w) for w in words}


def test_byte_pairs_without_a_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "known_pieces", lambda *_: b"")
    rows = [(0, "b" * 30 + "onthe" * 20 + " word the"), (1, "don't stop     x"), (2, "q" * 39 + "é")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: encoder().library.encode_ordinary(t) for i, t in rows}


def test_cached_encoder_equals_the_library():
    own, rng = Encoder(), random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "a", "the", "'s", "é", "1", " ", ".", "\x1c"]) for _ in range(rng.randint(0, 14)))
        assert own.encode(text).tolist() == own.library.encode_ordinary(text), repr(text)
    assert pieces("a b") == ["a", "b"]


def test_chat(spark):
    rows = [(1, 1, "assistant", "ok <|im_end|> <\\|x|>"), (1, 0, "user", "hi\n<|"), (1, 0, "user", "hi\n<|"), (2, None, None, None), (None, 0, "a\\n\nb", "<"), (3, 0, "assistant", ""),
            *[(4, k, "assistant" if k % 2 else "user", "text é " * k) for k in range(40)]]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in mine]
        out = bytes(got[conv].formatted)
        assert chat.read_back(out) == want and got[conv].n_turns == len(want)
        assert out.count(b"<|im_start|>") == out.count(b"<|im_end|>") == len(want)
        loss = [chat.unescape(out[a:b].decode()) for a, b in zip(got[conv].loss_starts, got[conv].loss_ends)]
        assert loss == [t for r, t in want if r == "assistant"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    rows = [(k, prose(rng, 60) + (" vile rotten" * (1 + k % 7) if k % 5 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)] + [(None, 1, 1), (5, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.grade(table, model).collect()}
    held = [k for k in range(300, 400)]
    assert all(got[k].rejected == (k % 5 == 0) for k in held)
    assert got[395].severity != got[396].severity and model.thresholds == tuple(sorted(model.thresholds))
    assert np.corrcoef([got[k].severity for k in held if k % 5 == 0], [1 + k % 7 for k in held if k % 5 == 0])[0, 1] > 0.6
    graded = toxicity.grade(docs, model)
    assert graded.count() == docs.count()
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.grade(docs, none).filter("severity > 0.01 OR rejected").isEmpty()
    assert toxicity.grade(empty, toxicity.fit(empty, labels)).count() == 0


def test_shared_weights_order_the_thresholds():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 3, 3000)
    grades = np.digitize(x + rng.logistic(0, 0.2, 3000), [0.8, 1.6, 2.4])
    w, theta = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, dtype=int), x, grades, 1, steps=2000)
    assert np.allclose(theta / w[0], [0.8, 1.6, 2.4], atol=0.1)


def test_the_ordinal_fit_is_a_stationary_point():
    """Central differences of the penalized likelihood, written out case by case, vanish at the fitted weights."""
    rng = np.random.default_rng(4)
    x = rng.poisson(0.7, (400, 5)).astype(float)
    grades = np.digitize(x @ [1.2, 0.6, -0.5, 0.0, 0.3] + rng.logistic(0, 1, 400), [0.5, 1.5, 2.5])
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, 5, steps=8000, rate=0.01)

    def objective(values):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            above = [1.0, *(1 / (1 + np.exp(t - row @ values[:5])) for t in values[5:]), 0.0]
            total += np.log(above[g] - above[g + 1])
        return total / len(x) - 1e-4 * (values[:5] ** 2).sum()

    at = np.concatenate([w, theta])
    for k in range(8):
        step = np.eye(8)[k] * 1e-4
        assert abs(objective(at + step) - objective(at - step)) / 2e-4 < 2e-3, k


def test_features_and_severity_equal_plain_python(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(0, 50)) + (" vile, ROTTEN" * (k % 4) if k % 3 == 0 else "")) for k in range(300)]
    rows += [(500, None), (501, ""), (None, "vile"), (7, "on rotten"), (600, "vile rotten " * 20_000)]
    marks = [(k, int(k % 3 == 0)) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, 1, m) for k, m in marks], "doc_id long, quality int, toxic int"))

    split = lambda text: Counter(w.encode() for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w)
    known, held = dict(marks), {0: [], 1: []}
    for k, text in rows:
        if k in known:
            held[known[k]].append(set(split(text)))
    size, want = {m: len(x) for m, x in held.items()}, set()
    for word in set().union(*held[0], *held[1]):
        a, b = (sum(word in x for x in held[m]) for m in (1, 0))
        p = (a + b) / (size[0] + size[1])
        z = (a / size[1] - b / size[0]) / np.sqrt(p * (1 - p) * (1 / size[1] + 1 / size[0]) + 1e-9)
        want |= {word} if abs(z) >= toxicity.FEATURE_Z else set()
    assert set(model.weights) == want and {b"vile", b"rotten"} <= want
    plain = Counter()
    for k, text in rows:
        score = sum(model.weights[w] * np.log(1 + n) for w, n in split(text).items() if w in model.weights)
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        plain[(k, round(sum(above), 9), above[0] >= 0.5)] += 1
    assert Counter((r.doc_id, round(r.severity, 9), r.rejected) for r in toxicity.grade(docs, model).collect()) == plain


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(prints))]


def test_simhash(docs, texts, empty):
    import xxhash
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = [(i, plain(t)) for i, t in texts]
    named = brute_components([p for _, p in want], 3)
    smallest = {}
    for (i, _), c in zip(want, named):
        smallest[c] = min(smallest.get(c, 1 << 60), 1 << 60 if i is None else i)
    assert Counter((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in got) == Counter((i, f"{p:016x}", smallest[c]) for (i, p), c in zip(want, named))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("sample", "shard_rows"), [(20_000, 32768), (60, 16), (50, 8)])
def test_vantage_points_find_every_link(spark, sample, shard_rows):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:60]:
        for _ in range(3):
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    classes = spark.createDataFrame([(k, p.to_bytes(8, "big")) for k, p in enumerate(prints)], "id long, fp binary").repartition(4)
    from attrloom.llm.components import components
    found = {r.id: r.component for r in components(simhash.links(classes, 64, 2, 3, sample=sample, shard_rows=shard_rows)).collect()}
    assert [found.get(k, k) for k in range(len(prints))] == brute_components(prints, 3)


def kept_by_brute_force(rows):
    """Rows that stay: of each group linked at 3 bits the smallest id (null last); of equal ids or rows one."""
    groups = {}
    for (i, t), c in zip(rows, brute_components([int.from_bytes(simhash.fingerprint((t or "").encode(), 3, 1)) for _, t in rows], 3)):
        groups.setdefault(c, []).append((i is None, i, t))
    least = [min(g, key=lambda x: (x[0], x[1] or 0))[1] for g in groups.values()]
    return Counter(least), {c: {x[1:] for x in g} for c, g in groups.items()}


def test_one_of_each_group_stays(docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids, groups = kept_by_brute_force(texts)
    assert Counter(i for i, _ in rows) == ids and len(rows) == len(groups)
    assert all(sum(x in g or (x[0], x[1] or "") in {(i, t or "") for i, t in g} for x in rows) == 1 for g in groups.values())
    assert 9 in ids and not {12, 13} & set(ids)  # exact copies of 9


def test_own_names_may_clash(spark):
    columns = "doc_id long, text string, _row int, _ID int, _doc int, row int, component int, name int, fp int, _fp int, id int, u int, v int"
    rows = [(i, t, *range(11)) for i, t in [(1, "a b c d"), (2, "a b c d"), (3, "e f g h i"), (3, "e f g h i"), (None, "x y z w")]]
    kept = simhash.keep_first(spark.createDataFrame(rows, columns))
    assert kept.columns == [c.split()[0] for c in columns.split(", ")]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


@pytest.mark.parametrize("ids", [(None, None, None), (3, 3, 3), (None, 3, None)])
def test_unrelated_texts_stay_whatever_their_ids(spark, ids):
    rng = random.Random(21)
    rows = [(i, prose(rng, 60)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in simhash.keep_first(docs).collect()) == Counter(rows)
    assert simhash.near_duplicates(docs).select("component").distinct().count() == 3


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.getrandbits(40)}"
    return " ".join(words)


def test_the_stage_equals_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = prose(rng, 600)
        texts += [base, *(edited(rng, base, n) for n in (1, 2, 2, 5, 6, 30))]
    rows = list(enumerate(texts))
    kept = Counter(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = kept_by_brute_force(rows)[0]
    assert kept == want and 12 < len(want) < len(rows)


def test_fingerprints(docs, texts, empty):
    got = Counter(tuple(r) for r in sketch.edit_check(docs).collect())
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = Counter()
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (sketch.sketch(x.encode()) for x in (text, edited, after))
        want[(i, len(text), sha(edited), sketch.written(a), sketch.written(b), sketch.likeness(a, b), sketch.likeness(a, c))] += 1
        assert (sketch.read(sketch.written(a)) == a).all()
    assert got == want
    assert sketch.edit_check(empty).count() == 0


def test_sketches_estimate_containment():
    rng = random.Random(4)
    long = prose(rng, 9000)
    part = " ".join(long.split(" ")[1000:3000])
    a, b = sketch.sketch(part.encode()), sketch.sketch(long.encode())
    assert sketch.containment(a, b) > 0.97 and abs(sketch.containment(b, a) - 2 / 9) < 0.06
    assert set(np.union1d(a, b)) == set(b) | set(a)


def test_packing(docs, texts, empty):
    rows = packing.pack(docs, row_tokens=64, block_tokens=700).collect()
    library, back = encoder().library, {}
    ids, positions = (packing.matrix([bytes(r[name]) for r in rows], 2) for name in ("input_ids", "position_ids"))
    assert ids.shape == positions.shape == (len(rows), 64) and all(r.id_bytes == r.position_bytes == 2 for r in rows)
    for r, row, place in zip(rows, ids, positions, strict=True):
        assert r.n_tokens == r.cu_seqlens[-1] <= 64 and not row[r.n_tokens:].any() and not place[r.n_tokens:].any()
        for doc, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(doc, []).append((at, row[a:b].tolist()))
            assert place[a:b].tolist() == list(range(b - a))
    want = {}
    for i, t in texts:
        want.setdefault(i, []).extend(library.encode_ordinary(t or ""))
    assert {i: sorted(x for _, p in parts for x in p) for i, parts in back.items()} == {i: sorted(x) for i, x in want.items() if x}
    assert [x for _, p in sorted(back[11]) for x in p] == want[11]
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_equals_the_plain_search():
    rng = np.random.default_rng(3)
    for capacity in (10, 64, 100):
        lengths = rng.integers(1, capacity + 1, 300)
        free, plain = [], []
        for piece in np.argsort(-lengths, kind="stable"):
            fits = [k for k in range(len(free)) if free[k] >= lengths[piece]]
            k = min(fits, key=lambda k: free[k]) if fits else len(free)
            if not fits:
                free.append(capacity)
            free[k] -= lengths[piece]
        plain = sorted(free)
        packs = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for p in packs for k in p) == list(range(300))
        assert sorted(capacity - int(lengths[p].sum()) for p in packs) == plain


def test_packed_files(spark, docs, tmp_path):
    packing.write_packs(packing.pack(docs, row_tokens=64), str(tmp_path / "packs"))
    assert all(len(r.input_ids) == len(r.position_ids) == 128 for r in spark.read.parquet(str(tmp_path / "packs")).collect())


def test_packing_widths_follow_the_values(spark, docs):
    """A pad value or a row beyond 16 bit takes wider items; a very long text fills whole rows and loses nothing."""
    assert [packing.width(n).itemsize for n in (1, 65536, 65537)] == [2, 2, 4]
    rows = packing.pack(docs, row_tokens=64, pad=1 << 16).collect()
    ids = packing.matrix([bytes(r.input_ids) for r in rows], 4)
    assert all(r.id_bytes == 4 and (row[r.n_tokens:] == 1 << 16).all() for r, row in zip(rows, ids, strict=True))
    text = prose(random.Random(2), 90_000)
    wide, = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), row_tokens=1 << 20).collect()
    want = encoder().library.encode_ordinary(text)
    assert wide.position_bytes == 4 and wide.n_tokens == len(want) > 1 << 16
    assert packing.matrix([bytes(wide.input_ids)], 2)[0][:len(want)].tolist() == want
    assert packing.matrix([bytes(wide.position_ids)], 4)[0][:len(want)].tolist() == list(range(len(want)))
    cut = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r.n_tokens == packing.ROW_TOKENS for r in cut) == len(want) // packing.ROW_TOKENS


def test_personal_data(docs, texts, empty):
    model = pii.fit(docs)
    got = {(r.doc_id, len(r.spans)): r for r in pii.find_spans(docs, model).collect()}
    row = next(r for (i, _), r in got.items() if i == 19)
    text = texts[19][1]
    assert [(s.kind, text[s.start:s.end]) for s in row.spans if s.base] == [
        ("email", "a.b-c@mail.example.org"), ("ip", "10.2.33.254"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (974) 555-3436")]
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    out = {r.text for r in clean.filter("doc_id = 19").collect()}
    assert out == {"Mail me: [EMAIL], [IP] [PHONE] or [CARD]."}
    assert pii.find_spans(empty, pii.fit(empty)).count() == 0


def plain_base(text):
    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits)
                    or kind == 3 and 8 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a.b", "@", "x-y", ".org", " ", "1.2.3.4", "255", ".", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+", "1", "(974) 555", "-", "555-1234567", "\n", "é", "0000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text, pii.stretches(text)) == plain_base(text), text


def test_the_classifier_adds_forms_the_base_misses(spark):
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(k, f"{prose(rng, 5)} +1 ({digits(3)}) 555-{digits(4)} {prose(rng, 5)} part {digits(9)}-{digits(2)} {prose(rng, 4)}") for k in range(300)]
    rows.append((1000, "the on ti (212) 555-7788 re on an"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.find_spans(table, pii.fit(table)).filter("doc_id = 1000").first().spans
    assert [(s.kind, s.start, s.end, s.base) for s in spans] == [("phone", 10, 24, False)]


def test_token_counts(docs, texts, empty):
    got = token_counts.count_tokens(docs).collect()
    library = encoder().library
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(library.encode_ordinary(t or ""))) for i, t in texts)
    assert all(sum(r.section_tokens) == r.n_tokens and r.n_sections == len(r.section_tokens) for r in got)
    assert token_counts.count_tokens(empty).count() == 0
    # "ab|cdef" as one token: most characters lie right, the first one left.
    first, stop, sections = np.array([0]), np.array([6]), np.array([0, 2])
    assert token_counts.attribute(first, stop, sections, 6, "most")[0].tolist() == [0, 1]
    assert token_counts.attribute(first, stop, sections, 6, "first")[0].tolist() == [1, 0]
    assert token_counts.attribute(first, np.array([4]), sections, 4, "most") [0].tolist() == [1, 0]


def plain_counts(text, starts, rule):
    """Every token's characters one by one: those that begin in its bytes, or else the one it continues."""
    library = encoder().library
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    heads = [k == 0 or of_byte[k] != of_byte[k - 1] for k in range(len(of_byte))]
    section = [max(n for n, s in enumerate(starts) if s <= k) for k in range(len(text))]
    counts, crossing, at = [0] * len(starts), 0, 0
    for token in library.encode_ordinary(text):
        end = at + len(library.decode_single_token_bytes(token))
        chars = [of_byte[k] for k in range(at, end) if heads[k]] or [of_byte[at]]
        held = Counter(section[c] for c in chars)
        owner = min(held, key=lambda n: (-held[n], n)) if rule == "most" else section[chars[0]]
        counts[owner] += 1
        crossing += len(held) > 1
        at = end
    return counts, crossing


@pytest.mark.parametrize("rule", ["most", "first"])
def test_section_counts_equal_the_plain_walk(spark, rule):
    rng = random.Random(12)
    parts = ["the", " on", "\n", "\n\n", " ", "é", "你好", "\U0001f600", "'ll", "12345", "x" * 9, "\r\n", "  "]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for k in range(120)]
    rows = [(k, t, rng.choice([None, [], [0], [rng.randint(-3, len(t) + 3) for _ in range(rng.randint(1, 9))] + [None, len(t)]])) for k, t in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string, marks array<int>")

    def lines(text):
        return [0, *(k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text))]

    for column in (None, "marks"):
        got = {r.doc_id: r for r in token_counts.count_tokens(table, rule=rule, sections=column).collect()}
        for k, text, marks in rows:
            starts = lines(text) if column is None or marks is None else sorted({0, *(m for m in marks if m is not None and 0 < m <= len(text))})
            assert (got[k].section_starts, (got[k].section_tokens, got[k].n_crossing)) == (starts, plain_counts(text, starts, rule)), (text, starts)


def test_field_counts(spark):
    rows = [(1, "the on", "é 你好", 5), (2, None, "", None), (3, "", "x\ny", 12), (None, "a", "b", 0)]
    table = spark.createDataFrame(rows, "doc_id long, title string, `the body` string, n int")
    got = {r.doc_id: r for r in token_counts.count_field_tokens(table, ["title", "the body", "n"]).collect()}
    for k, *fields in rows:
        texts = ["" if f is None else str(f) for f in fields]
        starts = [0, len(texts[0]) + 1, len(texts[0]) + len(texts[1]) + 2]
        assert (got[k].section_starts, (got[k].section_tokens, got[k].n_crossing)) == (starts, plain_counts("\n".join(texts), starts, "most"))
    with pytest.raises(ValueError, match="needed"):
        token_counts.count_field_tokens(table, [])


def test_decontamination(spark, docs, texts, empty):
    long = texts[10][1].split(" ")
    items = [(1, " ".join(long[20:45])), (2, long[3] + "; " + long[4].upper()), (3, ""), (4, None), (None, "zz qq"), (1, " ".join(long[20:45])), (5, " ".join(long[20:29]) + " qqq ww"), (6, "a")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    for block in (1 << 20, 10):
        got = decontaminate.find_matches(docs, bench, block_bytes=block).collect()
        want = []
        for i, t in texts:
            w, hit, found = split(t), set(), set()
            for item, text in items:
                b = split(text)
                n = min(10, len(b))
                for j in range(len(b) - n + 1 if n else 0):
                    for k in range(len(w) - n + 1):
                        if w[k:k + n] == b[j:j + n]:
                            hit |= set(range(k, k + n))
                            found.add(-1 if item is None else item)
            want.append((i, len(w), len(hit), tuple(sorted(found))))
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}))) for r in got) == Counter(want)
        assert (10, 25) in {(r.doc_id, max([m.n_words for m in r.matches], default=0)) for r in got}
        clean = decontaminate.decontaminate(docs, bench, block_bytes=block)
        assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in want)
    assert decontaminate.find_matches(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()
    assert decontaminate.find_matches(empty, bench).count() == 0


def test_a_word_repeated_in_document_and_item(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    docs = spark.createDataFrame([(1, "a " * 3000), (2, "b " + "a " * 40 + "c"), (3, "a a a"), (4, "x " * 10 + "a " * 10)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a " * 200), (2, "a a"), (3, "c " + "a " * 12)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_matches(docs, bench).collect()}
    assert [(got[i].n_words, got[i].n_hit, sorted({m.item_id for m in got[i].matches})) for i in (1, 2, 3, 4)] == [
        (3000, 3000, [1, 2, 3]), (42, 40, [1, 2, 3]), (3, 3, [2]), (20, 10, [1, 2, 3])]
    # Every diagonal of equal words is one match: the longest have the item's length.
    long = [m for m in got[1].matches if m.item_id == 1]
    assert max(m.n_words for m in long) == 200 and len({m.doc_start - m.item_start for m in long}) == len(long) == 3000 + 200 - 2 * 10 + 1


def test_many_repeats_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa
    from types import SimpleNamespace
    scanner = decontaminate.Scanner([SimpleNamespace(value=[(1, b"a " * 600)])], 10)
    tracemalloc.start()
    counts, hit, _ = scanner.scan(pa.array(["a " * 20_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (counts[0], hit[0]) == (20_000, 20_000) and peak < 600e6
