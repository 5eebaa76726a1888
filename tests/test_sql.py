"""Functions and table functions in SQL."""

from sextant.functions import sql


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select gkey('person', 'JOSÉ Ruiz') a, plain('Peña') b, title_words(\"o'NEILL\") c, unescape_html('a &eacute; b') d").first()
    assert tuple(row) == ("person:jose ruiz", "pena", "O'Neill", "a é b")
    spark.createDataFrame([(1, "one two three four"), (2, "x")], "k int, t string").createOrReplaceTempView("texts")
    assert spark.sql("select k, p.page_no, p.text from texts, lateral text_pages(t, 9) p order by 1, 2").count() == 4
    spark.createDataFrame([("INSERT INTO a (x) VALUES ('1'), (NULL)",)], "d string").createOrReplaceTempView("dumps")
    assert [r["row_no"] for r in spark.sql("select p.row_no from dumps, lateral dump_rows(d) p order by 1").collect()] == [1, 2]
    spark.createDataFrame([('{"ts": 1577836800, "from": "a", "text": "hi"}',)], "j string").createOrReplaceTempView("chats")
    assert spark.sql("select p.sender, p.chat from chats, lateral chat_lines(j, 'room') p").first()["chat"] == "room"
