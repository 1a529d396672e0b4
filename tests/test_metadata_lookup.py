import random

from pyspark.sql import functions as F

from webloom.functions.metadata import extract_metadata, with_metadata


QUOTES = "'" + '"'


def test_one_pass_equals_the_expressions(spark):
    """Odd tags too: several names or contents, quotes inside values, other cases, entities, unclosed tags."""
    r = random.Random(8)
    names = ["description", "author", "robots", "og:title", "og:image", "og:type", "twitter:card", "twitter:title", "Twitter:Site", "viewport", "OG:URL"]

    def attribute():
        return r.choice([
            lambda: f"""{r.choice(["name", "property", "NAME", "data-name", "itemprop"])}{r.choice(["=", " = "])}{r.choice(QUOTES)}{r.choice(names)}{r.choice(QUOTES)}""",
            lambda: f"""{r.choice(["content", "CONTENT", "data-content"])}={r.choice(QUOTES)}{r.choice(["x", "", "a &amp;lt; b", "it's", "a > b", "name='author'", "ÉK\U0001f600"])}{r.choice(QUOTES)}""",
            lambda: "charset=utf-8",
        ])()

    tag = lambda: f"<{r.choice(['meta', 'META', 'meta', 'link'])} {' '.join(attribute() for _ in range(r.randrange(1, 5)))}{r.choice(['>', '/>', '>', ''])}"
    rows = [(i, "<html><head>" + r.choice(["\n", ""]).join(tag() for _ in range(r.randrange(0, 9))) + "</head></html>") for i in range(500)] + [(500, None), (501, "no tags"), (502, "")]
    df = spark.createDataFrame(rows, "id int, html string").repartition(4)
    want = {x.id: x.m for x in df.select("id", F.when(F.col("html").isNotNull(), extract_metadata(F.col("html"))).alias("m")).collect()}
    got = {x.id: x.metadata for x in with_metadata(df).collect()}
    assert got == want
    assert sum(m is not None and m.og is not None for m in got.values()) > 20
