import random
import zlib

from tidemark.llm import kd_shards


def make(spark, n, seed=1, same=False):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = "x" * (50 if same else int(rng.paretovariate(1.3) * 40) % 3000)
        rows.append((k, text, rng.choice(["en", "en", "en", "de", None]), "s" if same else rng.choice(["hot"] * 5 + [f"s{j}" for j in range(9)]), 1))
    rows += [(None, "null id", "en", "hot", 1), (5, None, None, None, None), (5, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, tie INT").repartition(4)


def check(rows, shards, slack):
    found = rows.toPandas()
    total = found.groupby("shard")["size"].sum()
    assert set(total.index) == set(range(shards))
    assert total.max() - total.min() <= slack
    for _, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    return found


def test_leaves_have_near_equal_bytes(spark):
    documents = make(spark, 3000)
    found = check(kd_shards.kd_shards(documents, shards=7), 7, 4 * 3016)
    assert len(found) == 3003
    texts = {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents.collect()}
    assert {(None if i != i else int(i), s, c) for i, s, c in zip(found.doc_id, found["size"], found.text_crc32, strict=True)} == texts


def test_ties_in_all_dimensions_are_cut(spark):
    check(kd_shards.kd_shards(make(spark, 400, same=True), shards=5), 5, 4 * 66)


def test_target_bytes_give_the_number_of_shards(spark):
    documents = make(spark, 500)
    total = kd_shards.kd_shards(documents, shards=1).toPandas()["size"].sum()
    check(kd_shards.kd_shards(documents, target_bytes=int(total / 4) + 1), 4, 4 * 3016)


def test_tree_cuts_the_widest_dimension_at_weighted_medians(spark):
    rows = kd_shards._coordinates(make(spark, 1000), kd_shards.DIMENSIONS)
    names = [f"at_{d}" for d in kd_shards.DIMENSIONS]
    root = kd_shards.kd_tree(rows, names, 4)
    data = rows.toPandas()
    assert root.dim == max(names, key=lambda d: data[d].max() - data[d].min())
    q, t = root.cut
    left = data[(data[root.dim] < q) | ((data[root.dim] == q) & (data.tie < t))]["size"].sum()
    assert abs(left - data["size"].sum() / 2) <= 3016


def test_empty_table_and_one_row(spark):
    assert kd_shards.kd_shards(make(spark, 5).limit(0), shards=3).count() == 0
    one = kd_shards.kd_shards(make(spark, 5).where("doc_id = 1"), shards=3).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_written_shards_hold_their_documents(spark, tmp_path):
    documents = make(spark, 200).where("doc_id is not null").dropDuplicates(["doc_id"])
    assigned = kd_shards.kd_shards(documents, shards=3)
    kd_shards.write_shards(documents, assigned, f"{tmp_path}/out")
    read = spark.read.parquet(f"{tmp_path}/out")
    assert read.count() == documents.count() and {r.shard for r in read.select("shard").distinct().collect()} == {0, 1, 2}


def test_shards_match_a_plain_tree(spark):
    rng = random.Random(8)
    made = [(k, "y" * (60 + int(rng.paretovariate(1.1) * 40) % 9000), rng.choice(["en", "de", "fr", None]), rng.choice("aaaabc")) for k in range(400)]
    rows = kd_shards._coordinates(spark.createDataFrame(made, "doc_id BIGINT, text STRING, lang STRING, source STRING"), kd_shards.DIMENSIONS)
    names = [f"at_{d}" for d in kd_shards.DIMENSIONS]
    root = kd_shards.kd_tree(rows, names, 9)
    found = {r.doc_id: r.shard for r in rows.selectExpr("doc_id", f"{root.sql(lambda n: n.first)} as shard").collect()}
    want = {}

    def place(points, leaves, first):
        if leaves == 1:
            want.update((p.doc_id, first) for p in points)
            return
        dim = max(names, key=lambda d: max(p[d] for p in points) - min(p[d] for p in points))
        goal = sum(p["size"] for p in points) * (leaves // 2) // leaves
        points = sorted(points, key=lambda p: (p[dim], p.tie))
        sums = [0]
        for p in points:
            sums.append(sums[-1] + p["size"])
        at = min(range(len(sums)), key=lambda k: abs(sums[k] - goal))
        place(points[:at], leaves // 2, first)
        place(points[at:], leaves - leaves // 2, first + leaves // 2)

    place(rows.collect(), 9, 0)
    assert found == want


def test_very_long_text_and_repeated_rows(spark):
    rows = [(k, "z" * 100, "en", "s") for k in range(20)] + [(7, "z" * 100, "en", "s")] * 3 + [(99, "w" * 2_000_000, "en", "s")]
    found = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"), shards=4).toPandas()
    assert len(found) == 24 and found["size"].max() == 2_000_016
    assert all(sorted(s) == list(range(len(s))) for _, s in found.groupby("shard")["slot"])
