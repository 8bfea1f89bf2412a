"""The token store's Merkle manifest against stores that were tampered with, and tokenizers of other kinds."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.llm import token_store

OTHERS = [os.path.join("/opt/tokenizers", f) for f in sorted(os.listdir("/opt/tokenizers")) if f.endswith(".json")] if os.path.isdir("/opt/tokenizers") else []


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i % 40, f"text number {i} of this store " * (1 + i % 7)) for i in range(60)] + [(None, None)], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    token_store.write_store(docs, path)
    return token_store.open_store(spark, path)


def test_whole_store_is_read(store):
    assert token_store.read_back(store, 2).count() == 61
    levels = {r.level: r["count"] for r in store["manifest"].groupBy("level").count().collect()}
    assert levels["store"] == 1 and levels["file"] == store["recipes"].select("file").distinct().count() <= levels["page"]


@pytest.mark.parametrize(
    "tamper",
    [
        lambda r: r.where("doc_id is null or doc_id <> 17"),
        lambda r: r.union(r.where("doc_id = 5").limit(1)),
        lambda r: r.withColumn("doc_id", F.when(F.col("doc_id") == 30, 31).otherwise(F.col("doc_id"))),
        lambda r: r.withColumn("n_tokens", F.when(F.col("doc_id") == 30, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))),
        lambda r: r.limit(0),
    ],
    ids=["lost", "doubled", "renamed", "longer", "all lost"],
)
def test_changed_recipes_are_refused(store, tamper):
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_back(store | {"recipes": tamper(store["recipes"])}, 2)


@pytest.mark.parametrize("level", ["page", "file", "store"])
def test_changed_manifest_is_refused(store, level):
    changed = store["manifest"].withColumn("root", F.when(F.col("level") == level, F.sha2("root", 256)).otherwise(F.col("root")))
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_back(store | {"manifest": changed}, 2)


def test_lost_and_swapped_chunks_are_refused(store):
    chunks = store["chunks"]
    one = chunks.orderBy("digest").first().digest
    with pytest.raises(Exception, match="cannot be rebuilt"):
        token_store.read_back(store | {"chunks": chunks.where(F.col("digest") != F.lit(bytes(one)))}, 2).collect()
    swapped = store["recipes"].withColumn("digests", F.reverse("digests")).withColumn("digests", F.concat("digests", "digests"))
    with pytest.raises(Exception, match="cannot be rebuilt"):
        token_store.read_back(store | {"recipes": swapped}, 2).collect()


@pytest.mark.parametrize("path", OTHERS, ids=os.path.basename)
def test_every_tokenizer_gives_its_own_ids(spark, path):
    from tokenizers import Tokenizer

    try:
        tokenizer = Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no tokenizer file")
    texts = ["It's a Test, isn't it?  Two  spaces", "", None, "日本語 mixed Été", token_store.PROBE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_store.token_store(docs, path).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
