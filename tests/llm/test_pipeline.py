"""The stages of the pipeline on small tables with null ids, repeated rows and several texts of one id."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import brute_matches, sentence
from treelace.llm import bpe, decontam, langid, simhash
from treelace.llm.common import crc_mod

A, B, C, D = (sentence(60, k) for k in (71, 72, 73, 74))
#: (doc_id, text)
ROWS = [(5, A), (5, A), (9, A), (None, A), (None, A), (5, B), (7, B), (None, C), (None, C), (3, C + "!"), (4, D), (None, "only null ids here " + sentence(40, 75)), (None, "only null ids here " + sentence(40, 75)), (11, ""), (12, None), (None, "")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def near_groups():
    """Groups of ROWS whose fingerprints are linked by at most two differing bits."""
    fps = [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_one_row_of_each_near_group_stays(spark, rows):
    got = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert got.columns == rows.columns and corpus_pipeline.drop_near_duplicates(spark, rows.where("false"), "").count() == 0
    group = near_groups()
    where = {}
    for (k, t), g in zip(ROWS, group):
        where.setdefault(g, []).append(k)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    of = {(k, t): g for (k, t), g in zip(ROWS, group)}
    assert Counter(of[x] for x in kept) == Counter(where.keys())
    for x in kept:
        assert x[0] == min((k for k in where[of[x]] if k is not None), default=None)


def test_repeated_passages_of_repeated_rows(spark, rows):
    got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.remove_repeated_passages(spark, rows, "").collect()]
    assert len(got) == len(ROWS) and corpus_pipeline.remove_repeated_passages(spark, rows.where("false"), "").count() == 0
    firsts = {(k, t) for k, t in ((None, A), (5, B), (None, C), (4, D))}
    texts = Counter((k, t) for k, t, _ in got)
    assert all(texts[x] == Counter(ROWS)[x] for x in firsts)
    assert texts[9, ""] == 1 and texts[7, ""] == 1 and all(n == len(t or "") for _, t, n in got)


@pytest.mark.parametrize("bytes_a_block", [1 << 24, 300])
def test_contaminated_rows_go_by_row(spark, rows, monkeypatch, tmp_path, bytes_a_block):
    monkeypatch.setattr(decontam, "MAX_ITEM_BYTES", bytes_a_block)
    spark.createDataFrame([(1, B), (2, C), (3, "no match in any of them at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).collect())
    assert got == Counter((k, t) for k, t in ROWS if not (t or "").startswith((B, C)))


def test_run_equals_plain_versions_of_its_stages(spark, tmp_path):
    r = random.Random(8)
    other = lambda n: " ".join("".join(r.choice("vwxyz") for _ in range(6)) for _ in range(n))
    texts = [sentence(50, 200 + k) for k in range(12)] + [other(40) for _ in range(6)]
    texts += [texts[0], texts[1] + " tail", sentence(30, 300) + " " + texts[2][:250] + " " + sentence(30, 301), sentence(40, 302), "", "12 34 !", None, other(15) + " " + texts[13]]
    bench = [(1, " ".join(texts[21].split()[3:25])), (2, "nothing like it anywhere")]
    rows = [(k, t, "vv" if t and t[0] in "vwxyz" else "aa", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    left = []
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        buckets, off, _ = langid.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(buckets) and model.infer(buckets)[1][0] >= langid.MIN_SHARE:
            left.append((k, raw))
    fps = {k: simhash.fingerprint(raw) & (2**64 - 1) for k, raw in left}
    group = {k: k for k in fps}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                group = {k: min(group[a], group[b]) if g in (group[a], group[b]) else g for k, g in group.items()}
    left = [(k, raw) for k, raw in left if group[k] == k]
    seen, cut = set(), []
    for k, raw in left:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        cut.append((k, np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for k, t in cut:
        n, hit, _ = brute_matches(t, bench)
        if not (hit and 20 * hit >= n):
            ids = tok.encode(t, add_special_tokens=False).ids
            want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and 12 <= len(want) < len(texts) - 4 and 21 not in want and 18 not in want
