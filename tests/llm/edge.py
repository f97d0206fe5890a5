"""Rows every document operator must stand: nulls, empty and blank texts, a very
long text, repeats, and columns that clash with names used inside."""

from pyspark.sql import Row

LONG = " ".join(f"word{i % 997} item{i % 31}," for i in range(20_000))


def edge_docs(spark, extra=()):
    texts = [None, "", "   \t\n ", "one two", "one two", LONG, "Grüße aus Köln, 漢字 👍 ok", *extra]
    rows = [Row(doc_id=i, text=t, lang=None if i % 2 else "en", source=None if i == 3 else f"s{i % 3}",
                n_chars=None if t is None else len(t), score=0.5, spans="x", node=1, _text_="y", n=3, kind="z")
            for i, t in enumerate(texts)]
    rows.append(Row(doc_id=4, text="one two", lang="en", source="s1", n_chars=7, score=0.5, spans="x", node=1,
                    _text_="y", n=3, kind="z"))                        # a repeated row
    rows.append(Row(doc_id=None, text="row without an id at all here", lang=None, source=None, n_chars=None, score=None,
                    spans=None, node=None, _text_=None, n=None, kind=None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score double, spans string, node int, _text_ string, n int, kind string")
