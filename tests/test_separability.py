from fileguard.operators import tuning


def test_rows_after_the_bounded_prefix_count(spark):
    # The first two chunks of each class are alike, the later ones lie apart.
    rows = [(2 * i + label, label, float(i % 2) + (10.0 * label if i >= 4 else 0.0)) for i in range(40) for label in (0, 1)]
    df = spark.createDataFrame(rows, "row_id long, label int, file_name_entropy double")
    found = {r["n_sequences"]: r for r in tuning.hmm_separability(df, [2], [2]).collect()}
    assert found[2]["ks"] == 0.0
    assert abs(found[None]["ks"] - 0.9) < 1e-9 and found[None]["cohens_d"] > 1
    assert len(found) == 2
