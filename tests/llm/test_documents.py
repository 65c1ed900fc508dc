"""Operators on documents against brute force, on odd rows: nulls, empties, repeats, ties, clashing names."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lakegraph.llm import op1_quality as op1
from lakegraph.llm import op2_bpe as op2
from lakegraph.llm import op3_language_id as op3
from lakegraph.llm import op4_line_dedup as op4
from lakegraph.llm import op5_personal_data as op5
from lakegraph.llm import op6_decontaminate as op6
from lakegraph.llm import op8_minhash_dedup as op8
from lakegraph.llm import shared

# Columns that clash with what operators make or use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, ids string, score string, node string, "
          "n_lines string, key string, d1 string, pii string, length string, w string")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def odd_rows():
    rng = random.Random(7)

    def text(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))
    base = text(60)
    texts = [base, base.upper(), base + " more words here", base, None, "", "  \n\t ", "one two", "One  TWO", "only four words here",
             text(30) + "\n" + base, "x" * 300_000, text(40_000), "a shared line of text\nown " + text(9), "A SHARED line of text \nagain",
             "\n\na shared line of text\n", "é" * 12 + "\nÉ Ü ß", "short\nshort", "0123456789" * 30, "!?" * 50]
    half = base.split()
    texts += [" ".join(half[:50] + ["new"] * 3), " ".join(half[5:]), "near " + base, base.replace(half[30], "changed")]
    rows = [(i, t, "en" if i % 2 else "de", "s", 0) + ("x",) * 9 for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, None) + (None,) * 9, (None, None, None, None, None) + (None,) * 9, (5, "another text under a used id", "en", "s", 1) + ("x",) * 9]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_shingle_sets_of_long_words_and_texts():
    texts = ["x" * 1_500_000, "ab " * 400_000 + "y" * 700_000 + " z", " " * 600_000 + "a b c d e f", "a b", None]
    got = {i: len(s) for i, s in shared.shingle_sets(pa.array(texts))}
    assert got == {i: len(as_set(t)) for i, t in enumerate(texts)}


def test_near_duplicates(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = [as_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in groups[find(i)] if d is not None] if sets[i] else [doc]
        least = min(ids, default=None) if sets[i] else doc
        want.append((doc, len(sets[i]), least, least is None or doc == least))
    got = [tuple(r) for r in op8.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op8.near_duplicates(none).count() == 0
    kept = op8.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _, k in want if k and d is not None} | {None}


def test_many_near_copies_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(op8, "TILE_ROWS", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 5)):
            own[at] = f"v{i}-{at}"
        rows.append((i, " ".join(own)))
    sets = [as_set(t) for _, t in rows]
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["component_id"] for r in op8.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_tokens(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = op2.decode(op2.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert set(got.columns) == set(docs.columns) | {"decoded"}
    for r in got.collect():
        assert r["ids"] == tk.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    row = op2.digests(op2.tokenised(docs)).filter("doc_id = 4").first()
    assert (row["n_tokens"], row["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert op2.tokenised(none).count() == 0


def test_tokens_of_random_texts():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = op2.Vocabulary(path, public_tokenizers.PATTERN)
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    alphabets = ["ab \n\t'sdé1,.", "thelaiéñ", "".join(map(chr, range(32, 1000))), "日本語テキスト🙂 "]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(200))) for a in alphabets * 60] + ["a" * 3000, "ab" * 2000, " " * 900]
    assert [x.tolist() for x in own.encode(texts)] == [tk.encode_ordinary(t) for t in texts]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(op2, "REMEMBERED", 50)
    own = op2.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [" ".join(f"zq{i}x{j}" for j in range(30)) for i in range(20)] + ["zq0x0 the"] * 2
    assert [own.decode(own.encode([t])[0]).decode() for t in texts] == texts
    assert len(own.known) <= 50


def test_line_dedup(docs, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]

    def key(line):
        k = re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\v\f\r"))
        return k if len(k) >= 10 else None
    held = {}
    for doc, text in rows:
        for line in text.split("\n"):
            if doc is not None and key(line):
                held.setdefault(key(line), set()).add(doc)
    want = []
    for doc, text in rows:
        lines = text.split("\n")
        left = [s for s in lines if doc is None or not key(s) or len(held[key(s)]) < 2 or doc == min(held[key(s)])]
        want.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    got = op4.drop_shared_lines(docs)
    assert set(got.columns) == set(docs.columns) | {"n_dropped"}
    assert sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str) == sorted(want, key=str)
    assert op4.drop_shared_lines(none).count() == 0


def test_contained_items(spark, docs, none):
    texts = {r["doc_id"]: [] for r in docs.collect()}
    for r in docs.collect():
        texts[r["doc_id"]].append(as_set(r["text"]))
    base = odd_rows()[0][1]
    items = [(1, " ".join(base.split()[10:40])), (2, "Only FOUR words here"), (3, None), (None, base), (4, " "), (5, "nothing of this is anywhere at all"),
             (6, " ".join(base.split()[:20] + ["q"] * 12)), (1, "only four words here")]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, h string, n string")
    want = {}
    for i, t in items:
        for doc, sets in texts.items():
            for s in sets:
                shared_ = len(as_set(t) & s)
                if i is not None and doc is not None and shared_ and shared_ * 100 >= len(as_set(t)) * 75:
                    want[doc, i] = max(want.get((doc, i), (0, 0)), (shared_, len(as_set(t))))
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in op6.contained_items(docs, bench).collect()}
    assert got == want and got
    assert op6.contained_items(none, bench).count() == 0 == op6.contained_items(docs, bench.limit(0)).count()
    left = op6.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(texts) - {d for d, _ in want}


def test_shuffled_where_nothing_may_be_broadcast(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(odd_rows()[0][1].split()[10:40]))], "item_id long, text string")
    want = sorted(map(str, op6.contained_items(docs, bench).collect()))
    dups = sorted(map(str, op8.near_duplicates(docs).collect()))
    monkeypatch.setattr(op6, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(op8, "BROADCAST_IDS", -1)
    assert sorted(map(str, op6.contained_items(docs, bench).collect())) == want
    assert sorted(map(str, op8.near_duplicates(docs).collect())) == dups


def brute_personal_data(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and op5.luhn(digits):
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], op5.KINDS.index(s[2])))


def test_personal_data_of_random_texts():
    rng = random.Random(1)
    for _ in range(20_000):
        letters = rng.choice(["0123456789 -", "01.2+ (5)-9", "ab@.-_+ é1", "a@b.c", "+12 345-(6)7.8 9x", "0.1.25 5"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([3, 10, 30, 60])))
        assert [s for s in op5.find(text) if s[2] in op5.BASE] == brute_personal_data(text), text


def test_personal_data(docs, none):
    assert op5.find("IBAN: DE89 3704 0044 0532 0130 00. Account no. 12345678, x http://bob:pw@host.org/x accounted 1") == [
        (6, 33, "account"), (47, 55, "account"), (59, 81, "login"), (70, 81, "email")]
    got = op5.find_personal_data(docs)
    assert set(got.columns) == set(docs.columns)
    assert all([(s["start"], s["end"], s["kind"]) for s in r["pii"]] == op5.find(r["text"] or "") for r in got.collect())
    assert op5.find_personal_data(none).count() == 0


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seen = 0
    for r in op5.op5_personal_data(spark, "/root/testdata/sf0.01").collect():
        base = brute_personal_data(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in op5.BASE] == [sum(s[2] == k for s in base) for k in op5.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in op5.find(texts[r["doc_id"]]))
        seen += len(base)
    assert seen > 20


def test_language(spark, docs, none):
    rng = random.Random(4)
    sounds = {"aa": "ka lo mi tu", "bb": "sch rein ung ver", "cc": "tion eau ille ou", "dd": "ñ ando illo cia", "ee": "zw ij aa oe", "ff": "ssa ko lla en", "gg": "gwy dd ll yn"}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    for langs in (list(sounds)[:1], list(sounds)[:2], list(sounds)[:4], list(sounds)):
        train = [(i, text(langs[i % len(langs)], 30), langs[i % len(langs)]) for i in range(60 * len(langs))]
        model = op3.train(spark.createDataFrame(train + [(None, "x", "aa"), (9, None, "aa"), (10, "y", None)], "doc_id long, text string, lang string"))
        test = [(i, text(langs[i % len(langs)], 40), langs[i % len(langs)]) for i in range(70)]
        found = op3.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()
        assert sum(r["lang_pred"] == r["lang"] for r in found) >= 68
        assert all(0 <= r["score"] <= 1 for r in found)
    got = op3.identify(docs, model)
    assert set(got.columns) == set(docs.columns) | {"lang_pred", "ambiguous"}
    by_text = {r["text"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by_text[None] == by_text[""] == by_text["!?" * 50] == by_text["0123456789" * 30] == (op3.UNKNOWN, 0.0)
    assert op3.keep_identified(docs, model).columns == docs.columns
    assert op3.train(none) is None and op3.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in op3.identify(docs, None).collect()} == {op3.UNKNOWN}


def test_ngrams_of_long_texts_are_counted_in_pieces(monkeypatch):
    texts = ["abc déf " * 500, "x", "", None, "zz y" * 300]
    whole = np.concatenate(list(op3.gram_counts(pa.array(texts))))
    monkeypatch.setattr(op3, "PIECE", 64)
    assert np.array_equal(whole, np.concatenate(list(op3.gram_counts(pa.array(texts)))))
    assert whole[0].sum() == sum(len(texts[0].encode()) - k for k in range(4))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(24)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = op1.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in op1.score(docs, labels.limit(0)).collect()} == {0.5}
    assert op1.score(none, labels).count() == 0


def test_forest_learns_and_walks_like_its_trees():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = op1.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.98
    for row in x[:50]:
        total = forest.start
        for t in range(len(forest.feature)):
            at = 0
            for _ in range(op1.DEPTH):
                at = 2 * at + 1 + int(row[forest.feature[t, at]] > forest.threshold[t, at])
            total += forest.value[t, at]
        assert abs(1 / (1 + np.exp(-total)) - forest.score(row[None])[0]) < 1e-9


def test_quality_on_held_out_rows(spark):
    rows = op1.op1_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)


def test_language_on_held_out_rows(spark):
    held = op3.op3_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_pipeline_stages(spark, docs, none):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names, name
        assert stage(spark, none, folder).count() == 0, name
    before = corpus_pipeline.table(spark, folder, "documents")
    ids = {r["doc_id"] for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = shared.stored(stage(spark, before, folder), name)
        now = {r["doc_id"] for r in before.collect()}
        assert now <= ids and len(now) >= 0.8 * len(ids)
        ids = now
    assert "ids_sha256" in before.columns
