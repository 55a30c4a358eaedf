"""The pipeline on a small corpus, stage by stage, against plain Python."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from tidewake.llm.columns import parse_ranks, read_vocabulary
from tests.llm.test_index import words
from tests.llm.test_personal import slow as slow_spans
from tests.llm.test_simhash import slow_groups, slow_print

ENGLISH = "the ship came into the harbour with the tide and the crew went to the town for the night number"
FRENCH = "le navire est entré dans le port avec la marée et les marins sont allés à la ville pour la nuit numéro"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        rows.append((i, f"{ENGLISH} {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "a"))
        rows.append((100 + i, f"{FRENCH} {i} " + " ".join(f"é{i}y{j}" for j in range(30)), "fr", "b"))
    passage = " ".join(f"bench{j}" for j in range(12))
    rows += [(200, None, "en", "a"), (201, "", "fr", "a"), (202, "123 ?! 456", None, None), (203, rows[3][1], "fr", "c"), (204, rows[3][1] + " x", "fr", "c"),
             (205, f"{ENGLISH} mail to a.b@c.example now " + " ".join(f"m{j}" for j in range(40)), "en", "a"),
             (206, f"{ENGLISH} {passage} " + " ".join(f"k{j}" for j in range(40)), "en", "a"), (5, rows[10][1], "en", "a"), (5, rows[10][1], "en", "a"),
             (207, "w " * 30_000 + ENGLISH, "en", "a"), (None, f"{ENGLISH} nobody " + " ".join(f"q{j}" for j in range(40)), "en", "a")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage + "."), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def expected(rows):
    kept = {r for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    prints = {r: slow_print(r[1]) for r in kept}
    groups = slow_groups(list(prints.values()))
    least = {}
    for r in kept:
        if r[0] is not None:
            g = groups[prints[r]]
            least[g] = min(least.get(g, r[0]), r[0])
    kept = {r for r in kept if r[0] == least.get(groups[prints[r]])}
    bench = words(" ".join(f"bench{j}" for j in range(12)))
    passages = {tuple(bench[k:k + 10]) for k in range(3)}
    hit = lambda w: any(tuple(w[i:i + 10]) in passages for i in range(len(w)))
    return {r for r in kept if not hit(words(r[1]))}


def test_stages_and_run(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            docs.write.mode("overwrite").parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
    assert not {200, 201, 202} & seen["language_id"] and {203, 205, None} <= seen["language_id"]
    assert 203 not in seen["near_copies"] and 206 in seen["near_copies"] and 206 not in seen["decontamination"]
    want = expected(rows)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=parse_ranks(read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))
    got = cp.run(spark, path).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in want), key=str)
    for r in got:
        text = next(t for k, t, *_ in want if k == r.doc_id)
        for kind, a, b in sorted(slow_spans(text), key=lambda s: -s[1]):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        assert list(r.ids) == library.encode_ordinary(text) and r.n_chars == len(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_language_decides(spark):
    """Texts in four scripts; one that deals its words to all four has no language, unless it is short."""
    letters = {"a": "abcdefg", "b": "hijklmn", "c": "opqrstu", "d": "vwxyzßé"}
    text = lambda s, k: " ".join("".join(s[(k * 7 + i * j * j + i + j) % 7] for j in range(5)) for i in range(40))
    rows = [(100 * n + k, text(s, k), lang) for n, (lang, s) in enumerate(letters.items()) for k in range(40)]
    mixed = " ".join(text(s, 3)[:60] for s in letters.values())
    rows += [(900, mixed, None), (901, mixed[:0] + "b", None), (902, "12 ?!", "a"), (903, None, "a")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in cp.identify_language(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} - {900, 902, 903}


def test_no_labels(spark):
    rows = [(1, "été", None, "x", 3), (2, "12 ?!", None, "x", 5), (3, None, None, "x", 0), (4, "", None, "x", 0), (5, "the ship", None, "x", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.identify_language(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 5}
