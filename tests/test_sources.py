from __future__ import annotations

import gzip

import pytest
from pyspark.ml.classification import LogisticRegressionModel

from cohortloom import schemas, sources
from cohortloom.operators import models


def test_csv_by_name_with_column_list(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text('RACE,Id,FIRST\nwhite,1,"A, B"\n')
    df = sources.read_csv(spark, str(file), schemas.PATIENTS, ["Id", "FIRST", "LAST"])
    assert [tuple(r) for r in df.collect()] == [("1", "A, B", None)]


def test_csv_files_with_other_headers(spark, tmp_path):
    first, second = tmp_path / "a" / "p.csv", tmp_path / "b" / "p.csv"
    for file, text in ((first, "Id,FIRST,LAST\n1,Ann,Lee\n"), (second, "LAST,Id\nPoe,2\n")):
        file.parent.mkdir()
        file.write_text(text)
    df = sources.read_csv(spark, [str(first), str(second)], schemas.PATIENTS, ["Id", "FIRST", "LAST"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "Ann", "Lee"), ("2", None, "Poe")]
    (first.parent / "q.csv").write_text("LAST,FIRST,Id\nPoe,Bob,2\n")
    with pytest.raises(Exception, match="header"):
        sources.read_csv(spark, str(first.parent), schemas.PATIENTS, ["Id", "FIRST", "LAST"]).collect()


def test_keyed_files_by_name(spark, tmp_path):
    header = "INDEX,VARIANT,CHROMOSOME,NAME,LOCATION,ANCESTRAL_ALLELE,ALLELE,VARIANT_ALLELE_LIST\n"
    (tmp_path / "Abe_Long_77_dna.csv").write_text(header + "0,true,1,rs1,55,A,A>C,C\n")
    row = sources.read_keyed_folder(spark, str(tmp_path), schemas.GENOTYPE_CALLS).first()
    got = (row["PATIENT_ID"], str(row["CHROMOSOME"]), str(row["LOCATION"]), row["ANCESTRAL_ALLELE"], row["VARIANT_ALLELE_LIST"])
    assert got == ("77", "1", "55", "A", "C")
    (tmp_path / "Abe_Long_77_dna.csv").write_text("CHROMOSOME\n1\n")
    with pytest.raises(ValueError, match="LOCATION"):
        sources.read_keyed_folder(spark, str(tmp_path), schemas.GENOTYPE_CALLS)


def test_zipped_tsv(spark, tmp_path):
    file = tmp_path / "s.tsv.gz"
    with gzip.open(file, "wt") as out:
        out.write("chromosome\tbase_pair_location\tbeta\tp_value\n1\t5.0\t0.25\tNA\n")
    df = sources.read_tsv(spark, str(file), schemas.SUMMARY_STATISTICS, ["base_pair_location", "beta", "p_value"], 2)
    assert [tuple(r) for r in df.collect()] == [("5.0", 0.25, None)]


def test_one_file_per_entity(spark, tmp_path):
    header = "CHROMOSOME,LOCATION,ANCESTRAL_ALLELE,VARIANT_ALLELE_LIST,ALLELE,VARIANT\n"
    for key in ("77", "78"):
        (tmp_path / f"Abe_Long_{key}_dna.csv").write_text(header + f'1,{key},A,"""C, G""",A>C,true\n')
    df = sources.read_keyed_folder(spark, str(tmp_path), schemas.GENOTYPE_CALLS)
    got = sorted((r["PATIENT_ID"], r["LOCATION"], r["VARIANT_ALLELE_LIST"]) for r in df.collect())
    assert got == [("77", "77", '"C, G"'), ("78", "78", '"C, G"')]


def test_sinks_and_stack(spark, tmp_path):
    a = spark.createDataFrame([(" x", 1)], "k string, v int")
    sources.write_csv(a, str(tmp_path / "a"))
    back = spark.read.option("header", True).csv(str(tmp_path / "a"))
    assert back.first()["k"] == " x"
    sources.write_parquet(a, str(tmp_path / "b"))
    stacked = sources.stack_by_name([sources.read_parquet(spark, str(tmp_path / "b")), spark.createDataFrame([(2.0,)], "w double")])
    assert stacked.columns == ["k", "v", "w"] and stacked.count() == 2


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [2.0, 0.0])], "y int, a array<double>")
    model = models.fit_logistic(models.from_arrays(df, "a", "y"), max_iter=20)
    sources.save_model(model, str(tmp_path / "m"))
    again = sources.load_model(LogisticRegressionModel, str(tmp_path / "m"))
    assert again.coefficients == model.coefficients
