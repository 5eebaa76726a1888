"""The engine's functions for use in SQL: scalar functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sextant.functions import fold


def register(spark: SparkSession) -> list[str]:
    """Registers ``gkey(type, name)``, ``plain(s)``, ``title_words(s)`` and
    ``unescape_html(s)``, and the table functions ``text_pages(text, size)``,
    ``dump_rows(dump)`` and ``chat_lines(json, chat)`` for use with LATERAL."""
    from sextant.sources import formats, records

    for name, function in (("gkey", fold.gkey), ("plain", fold.plain), ("title_words", fold.title), ("unescape_html", fold.unescape)):
        spark.udf.register(name, function)

    @udtf(returnType="page_no int, text string")
    class TextPages:
        def eval(self, text: str, size: int):
            yield from enumerate(formats.paginate(text or "", size), 1)

    @udtf(returnType="table string, row_no bigint, values map<string,string>")
    class DumpRows:
        def eval(self, dump: str):
            yield from records.insert_rows(dump or "")

    @udtf(returnType="stamp string, sender string, recipient string, chat string, text string")
    class ChatLines:
        def eval(self, text: str, chat: str):
            for value in records.json_values(text or ""):
                yield from records.flatten_messages(value, chat)

    tables = {"text_pages": TextPages, "dump_rows": DumpRows, "chat_lines": ChatLines}
    for name, function in tables.items():
        spark.udtf.register(name, function)
    return ["gkey", "plain", "title_words", "unescape_html", *tables]
