"""SQL over the registered views equals the DataFrame operators."""

from pyspark.sql import functions as F

from strata.plans.views import VIEW_NAMES, register_views


def test_sql_over_views(spark, sf_small):
    frames = register_views(spark, sf_small)
    counts = spark.sql("""
        SELECT c.Life_Stage, c.Gender, f.Severity_Class, COUNT(*) AS n, MAX(f.Risk_Score) AS worst
        FROM patients_clean c JOIN patients_features f ON c.id = f.id JOIN patients_raw r ON r.id = c.id
        GROUP BY c.Life_Stage, c.Gender, f.Severity_Class""")
    c, f = frames["patients_clean"], frames["patients_features"]
    same = (c.select("id", "Life_Stage", "Gender").join(f.select("id", "Severity_Class", "Risk_Score"), "id")
            .groupBy("Life_Stage", "Gender", "Severity_Class").agg(F.count(F.lit(1)).alias("n"), F.max("Risk_Score").alias("worst")))
    assert counts.exceptAll(same).count() == 0 and same.exceptAll(counts).count() == 0
    assert counts.agg(F.sum("n")).first()[0] == frames["patients_raw"].count()


def test_every_view_is_registered(spark, sf_small):
    frames = register_views(spark, sf_small)
    for name in VIEW_NAMES:
        assert spark.table(name).columns == frames[name].columns
