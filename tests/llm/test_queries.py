"""The registered queries over whole small folders of tables: against brute force, the library, or held-out accuracy."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from treelace.llm import bpe, suffix
from treelace.llm.queries import QUERIES

from test_operators import brute_matches, components_of, corpus, plain_fingerprint, sentence, vectors

LETTERS = {"aa": "abcde", "bb": "vwxyz", "cc": "mnopq"}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, spans long, shard int, label string",
    "labels": "doc_id long, quality int, toxic int, text string",
    "embeddings": "vec_id long, embedding array<float>, label int, raw int",
    "pages": "page_id long, url string, html string, digest string",
    "benchmark": "item_id long, text string, words int",
}
LONG = " ".join(sentence(30, k % 400) for k in range(900))  # 200 KB and more, with repeats of its own
ITEMS = [(1, " ".join(sentence(60, 2).split()[5:30])), (10, sentence(40, 99).upper()), (2, "one"), (3, None), (4, " !! "), (None, sentence(60, 0)), (5, sentence(12, 7)), (5, sentence(60, 5))]


def write(spark, folder, tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def document(k, text, lang="en"):
    return (k, text, lang, f"s{(k or 0) % 3}", len(text or ""), 1, 2, "clash")


@pytest.fixture(scope="module")
def texts():
    return [*corpus(), (900, LONG), (901, LONG[:50_000] + " another end")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    return write(spark, tmp_path_factory.mktemp("sf"), {"documents": [document(k, t) for k, t in texts], "embeddings": [(k, v, 1, 2) for k, v in vectors()], "benchmark": [(k, t, 1) for k, t in ITEMS]})


def rows(spark, name, sf, key="doc_id"):
    out = QUERIES[name](spark, sf).collect()
    return {r[key]: r for r in out}, len(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    df = QUERIES[name](spark, write(spark, tmp_path, {}))
    assert df.count() == 0 and len(df.columns) >= 3


def test_op2(spark, folder):
    got, n = rows(spark, "op2_embedding_dedup", folder, "vec_id")
    given = {k: None if v is None or None in v else np.array(v, np.float32).astype(float) for k, v in vectors()}
    good = {k: v / np.linalg.norm(v) for k, v in given.items() if v is not None and len(v) and np.isfinite(v).all() and v.any()}
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    degree = {k: sum(k in e for e in links) for k in given}
    comp = components_of(len(given), links)
    assert n == len(given) and all(got[k].n_links <= degree[k] for k in degree) and sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values()) > 0
    assert sum(got[k].component_id == comp[k] for k in given) >= 0.97 * n and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_op3(spark, folder, texts):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_vocabulary())
    got, n = rows(spark, "op3_bpe", folder)
    assert n == len(texts)
    for k, t in texts:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op4(spark, folder, texts):
    got, n = rows(spark, "op4_suffix_dedup", folder)
    want = suffix.brute_force([(k, (t or "").encode()) for k, t in texts])
    assert n == len(texts) and [tuple(got[w[0]][c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for w in want] == [tuple(w) for w in want]
    assert got[901].n_removed >= 50_000


def test_op6(spark, folder, texts):
    got, n = rows(spark, "op6_decontaminate", folder)
    assert n == len(texts)
    for k, t in texts:
        words, hit, found = brute_matches(t, ITEMS)
        assert (got[k].n_words, got[k].n_hit, got[k].n_items) == (words, hit, len(found)), k
        assert got[k].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and got[k].contaminated == (hit > 0 and 20 * hit >= words)


def test_op7(spark, folder, texts):
    got, n = rows(spark, "op7_kd_shards", folder)
    assert n == len(texts) and {r.law for r in got.values()} == {"bytes"} and {r.grown_shard for r in got.values()} == {None}
    for k, t in texts:
        raw = (t or "").encode()
        assert (got[k].size, got[k].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))
    groups = {}
    for k, t in texts:
        groups.setdefault(t or "", set()).add(got[k].shard)
    assert all(len(x) == 1 for x in groups.values()) and got[900].shard != got[901].shard


def test_op9(spark, folder, texts):
    got, n = rows(spark, "op9_simhash", folder)
    prints = [plain_fingerprint(t) for _, t in texts]
    comp = components_of(len(texts), [(a, b) for a, b in combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert n == len(texts) and [(got[k].fingerprint, got[k].component_id) for k, _ in texts] == [(f"{p:016x}", texts[c][0]) for p, c in zip(prints, comp)]


def fold(k, n):
    return k is not None and zlib.crc32(str(k).encode()) % n


def learned(spark, tmp_path, name, key, tables, flipped):
    """The query's rows, and those where all that it may not learn from is another."""
    a = rows(spark, name, write(spark, tmp_path / "a", tables))[0]
    b = rows(spark, name, write(spark, tmp_path / "b", flipped))[0]
    assert {k: r[key] for k, r in a.items()} == {k: r[key] for k, r in b.items()}
    return a


def test_op1_learns_from_its_folds_only(spark, tmp_path):
    r = random.Random(3)
    text = lambda x: " ".join("".join(r.choice(LETTERS[x]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(8, 60)))
    true = {k: r.choice(list(LETTERS)) for k in range(160)}
    docs = [document(k, text(x), x) for k, x in true.items()]
    docs += [document(500, None), document(501, "12 !?"), document(502, ""), document(503, text("bb") * 400, None), document(None, text("cc"), None), document(504, text("aa"), None), document(504, text("aa"), None)]
    other = [d if fold(d[0], 4) != 2 else (*d[:2], "zz", "elsewhere", *d[4:]) for d in docs]
    got = learned(spark, tmp_path, "op1_language_id", "score", {"documents": docs}, {"documents": other})
    held = [k for k in true if fold(k, 4) == 2]
    assert len(held) > 20 and sum(got[k].lang_pred == true[k] for k in held) >= 0.98 * len(held)
    assert all(x.held_out == (k is not None and fold(k, 4) == 2) and 0 <= x.score <= 1 for k, x in got.items())
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and (got[503].lang_pred, got[504].lang_pred, got[None].lang_pred) == ("bb", "aa", "cc")


def test_op8_learns_from_its_folds_only(spark, tmp_path):
    r = random.Random(2)
    words = ("BUY now!! click $$$ free*** winner page site".split(), "calm river stone field quiet morning page site".split())
    true = {k: r.randint(0, 1) for k in range(200)}
    docs = [document(k, " ".join(r.choice(words[q]) for _ in range(r.randint(10, 50)))) for k, q in true.items()]
    docs += [document(500, None), document(501, ""), document(502, " ".join(words[1]) * 3000), document(None, "calm river")]
    labels = [(k, q, 0, "clash") for k, q in true.items()] + [(7, None, 1, None), (None, 1, 0, None), (9999, 0, 0, "no document")]
    other = [(k, 1 - q, *x) if fold(k, 3) == 1 and q is not None else (k, q, *x) for k, q, *x in labels]
    got = learned(spark, tmp_path, "op8_quality", "predicted", {"documents": docs, "labels": labels}, {"documents": docs, "labels": other})
    held = [k for k in true if fold(k, 3) == 1]
    assert len(held) > 40 and sum(got[k].predicted == true[k] for k in held) >= 0.95 * len(held)
    assert all(x.held_out == (k is not None and fold(k, 3) == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for k, x in got.items())
    assert got[500].score == got[501].score and got[502].predicted == 1
