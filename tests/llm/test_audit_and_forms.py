"""Filter audit, fill-in-middle and SentencePiece against brute force and the library, on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lakegraph.llm import op11_filter_audit as op11
from lakegraph.llm import op12_fill_in_middle as op12
from lakegraph.llm import op13_sentencepiece as op13

# Columns that clash with what operators make or use inside.
SCHEMA = ("doc_id long, text string, lang string, ids string, decoded string, fim string, form string, n_units string, state string, "
          "mask string, n string, f string, part string, text_key string, n_words string, _key string")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(5)
    letters = "abcdehinorstTHE  ▁ .,'\n\t0123é😀ñßжпр的是x-_=<>PSM$"
    texts = [None, "", " ", "   ", "\n", "\n\n a \nb", "▁", "<P>", "a<S>b", "<M", "é", "😀" * 700, "x" * 5000, " " * 3000, "ther" * 900, "\x00\r\n",
             "<s></s><unk><0x41>", "Word " * 210, "word " * 150 + "$", "UPPER lower " * 120, "same text here", "same text here", "same text here"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    return texts


def odd_rows():
    rows = [(i, t, ("en", "de", None, "")[i % 4]) + ("x",) * 13 for i, t in enumerate(odd_texts())]
    return rows + [rows[20], (20, "another text under a used id", "en") + ("x",) * 13,
                   (None, "same text here", "en") + (None,) * 13, (None, None, None) + (None,) * 13]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- filter audit

def test_word_counts_of_pieces(monkeypatch):
    monkeypatch.setattr(op11, "PIECE", 7)
    for text in odd_texts():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))
        assert op11._counts(text.encode()) == want


def test_path_counts_list_all_orders():
    for k in range(5):
        reach, leave = op11.path_counts(k)
        orders = list(permutations(range(k)))
        for state in range(1 << k):
            through = sum(any({*o[:i]} == {f for f in range(k) if state >> f & 1} for i in range(k + 1)) for o in orders)
            assert reach[state] * leave[state] == through
    assert op11.path_counts(0) == ([1], [1])


def _fails(rows):
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in rows)})
    return out


def test_audit_of_odd_rows(spark, tmp_path, docs):
    rows = odd_rows()
    labels = [(i, i % 3 != 0, i % 5 == 0) for i in range(0, 120)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(a, int(b), int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = {a for a, b, _ in labels if b and a is not None}
    toxic = {a for a, _, c in labels if c and a is not None}
    fails, want = _fails(rows), {}
    shapley = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = mine, []
            for step, name in enumerate(order, 1):
                away = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                want[part, order, step] = (
                    len(left), len(away), sum(x[1][name] for x in gone), sum(x[1][name] and sum(x[1].values()) == 1 for x in mine),
                    sum(x[0] in good for x in away), sum(x[0] in toxic for x in away))
                shapley[part, name] = shapley.get((part, name), 0) + len(away)
                gone = gone + away
    got = op11.op11_filter_audit(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == len({r["part"] for r in got}) * 600
    for r in got:
        key = r["part"], r["filter_order"], r["step"]
        assert want[key] == tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))
        assert r["shapley"] == shapley[r["part"], r["filter"]] and r["filter"] == r["filter_order"][r["step"] - 1]


def test_audit_of_other_filters(spark, docs, none):
    from pyspark.sql import functions as F
    got = op11.audit(docs, {"x": F.col("doc_id") > 10, "y": F.col("text").contains("a")}, losses={"old": F.col("lang") == "de"})
    assert got.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "old_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]) for r in got.collect()} == {("", o, s) for o in ("xy", "yx") for s in (1, 2)}
    assert op11.audit(none, {"x": F.col("doc_id") > 10}).count() == 0
    assert op11.audit(docs, {"x": F.lit(None).cast("boolean")}).first()["removed"] == 0
    with pytest.raises(ValueError):
        op11.audit(docs, {str(i): F.lit(True) for i in range(9)})
    assert op11.with_later_copies(op11.statistics(docs), "copy", "text").count() == docs.count()


# ---- fill-in-middle

def units_of(text, unit):
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    lead = re.match(r"[\x20\x09-\x0D]*", text).group()
    return [lead + words[0], *words[1:]] if words else [text] if text else []


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("unit", op12.UNITS)
def test_forms(docs, unit, block):
    made = op12.fill_in_middle(docs, unit=unit, block=block, seed=9, fim_percent=80, spm_percent=50)
    assert set(made.columns) == set(docs.columns) | {"prefix_chars", "middle_chars"}
    forms = set()
    rows = {(r[0], r[1]) for r in odd_rows()}
    got = made.select("doc_id", "text", "fim", "form", "n_units", "prefix_chars", "middle_chars", op12.restored().alias("back")).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == rows and len(got) == len(odd_rows())
    for r in got:
        text = r["text"] or ""
        units = units_of(text, unit)
        digest = hashlib.sha256(f"9:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        assert r["n_units"] == len(units) and r["back"] == text
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 80:
            want = ("plain", text, None, None)
        elif h[3] % 100 < 50:
            want = ("spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid))
        else:
            want = ("psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid))
        assert (r["form"], r["fim"], r["prefix_chars"], r["middle_chars"]) == want
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_no_forms_of_nothing(none, docs):
    assert op12.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        op12.fill_in_middle(docs, unit="pages")


def test_trees_hold_sums_of_blocks():
    data = np.frombuffer("aé😀 b\n".encode() * 40, np.uint8)
    trees = op12.Trees(data, np.array([0, 0, 100, 101, len(data)]), "chars", 4)
    for row in range(4):
        nodes = trees.tree[0][trees.base[row]:trees.base[row + 1]]
        for i in range(1, len(nodes) + 1):
            at = trees.offsets[row] + 4 * (i - (i & -i))
            end = min(trees.offsets[row] + 4 * i, trees.offsets[row + 1])
            assert nodes[i - 1] == np.count_nonzero((data[at:end] & 0xC0) != 0x80)


# ---- SentencePiece

def test_pieces_equal_the_library(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = op13.decode(op13.encode(docs, PATH), PATH, digest="hash")
    assert set(got.columns) == set(docs.columns) | {"hash"}
    for r in got.collect():
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
        assert r["hash"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    bare = op13.encode(docs.filter("doc_id = 12"), PATH, begin=False, end=False).first()["ids"]
    assert bare == library.encode("x" * 5000)
    assert op13.decode(op13.encode(none, PATH), PATH).count() == 0


def test_random_pieces_and_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own, rng = op13.Model(PATH), random.Random(8)
    texts = ["".join(rng.choice("then aio▁  r.,") for _ in range(rng.randrange(1, 200))) for _ in range(1500)]
    texts += ["".join(rng.choice("的是éßЖ😀 \n09aT") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for got, text in zip(own.encode(texts), texts):
        assert got.tolist() == library.encode(text, add_bos=True, add_eos=True), text
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, int)) == library.decode(ids), ids


def test_long_texts_and_memory_of_words(monkeypatch):
    monkeypatch.setattr(op13, "CHARS", 100)
    monkeypatch.setattr(op13, "WORDS", 7)
    monkeypatch.setattr(op13, "REMEMBERED", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own, rng = op13.Model(PATH), random.Random(4)
    texts = ["".join(rng.choice("the quick brown fox ,.\n é") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["", "a"]
    for got, text in zip(own.encode(texts), texts):
        assert got.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    whole = proto.ModelProto()
    with open(PATH, "rb") as file:
        whole.ParseFromString(file.read())
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
                   lambda m: setattr(m.pieces[500], "type", 4)):
        other = proto.ModelProto()
        other.CopyFrom(whole)
        change(other)
        (tmp_path / "m").write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            op13.Model(str(tmp_path / "m"))
