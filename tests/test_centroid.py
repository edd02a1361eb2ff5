import math

from tidemark.queries import QUERIES


def test_every_row_meets_the_means_of_all(spark, tmp_path):
    rows = [(k, k % 3, [float(k % 3 * 4 + k % 5), float(k * k % 7)]) for k in range(24)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    means = {c: [sum(e[i] for _, x, e in rows if x == c) / 8 for i in range(2)] for c in range(3)}
    want = {k: min((math.dist(e, m), c) for c, m in means.items()) for k, _, e in rows}
    got = {r.vec_id: (r.cluster, r.distance) for r in QUERIES["nearest_centroid"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == c and abs(got[k][1] - d) < 1e-5 for k, (d, c) in want.items())
