"""Schemas of the engine's tables, as DDL."""

REF = "STRUCT<type:STRING,name:STRING,key:STRING,aliases:ARRAY<STRING>,description:STRING,source:STRING>"
RELATION = f"STRUCT<src:{REF},type:STRING,dst:{REF}>"
PAGE = "STRUCT<n:INT,text:STRING,ocr:INT>"
SRC = "STRUCT<file:STRING,zip:STRING,archive:STRING,atype:STRING,member:STRING,mbox:STRING,idx:INT,files:ARRAY<STRING>,record:STRING,row_no:BIGINT,node:STRING>"

EXTRACTED = (
    "id STRING, relpath STRING, kind STRING, sha1 STRING, title STRING, author STRING, doc_date STRING, origin STRING,"
    " classification STRING, collection STRING, member STRING, error STRING, fields MAP<STRING,STRING>,"
    f" pages ARRAY<{PAGE}>, entities ARRAY<{REF}>, relations ARRAY<{RELATION}>, src {SRC}"
)
DOCUMENTS = (
    "corpus_id STRING, id STRING, relpath STRING, filename STRING, kind STRING, title STRING, collection STRING,"
    " publisher STRING, published STRING, doc_date STRING, date_source STRING, year INT, pages INT, chars BIGINT, ocr_pages INT,"
    " origin STRING, classification STRING, author STRING, summary STRING, sha1 STRING, duplicates ARRAY<STRING>,"
    f" sources ARRAY<STRING>, member STRING, error STRING, fields MAP<STRING,STRING>, src {SRC}"
)
PAGES = "corpus_id STRING, page_uid BIGINT, doc_id STRING, page_no INT, text STRING, ocr INT"
MENTIONS_RAW = "corpus_id STRING, key STRING, doc_id STRING, page_no INT, count INT, src INT"
ENTITIES = (
    "corpus_id STRING, id INT, key STRING, name STRING, type STRING, description STRING, aliases ARRAY<STRING>, auto INT,"
    " doc_count BIGINT, mention_count BIGINT, first_year INT, last_year INT, source STRING"
)

#: Entity types in display order, and evidence codes of raw mentions.  Fixed values.
TYPES = ("person", "agency", "company", "program", "technology", "place", "organization", "idea", "identifier")
GAZETTEER, NER_KNOWN, NER_NEW, PATTERN, STRUCTURED = range(5)
