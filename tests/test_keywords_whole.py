import re
import unicodedata

from photoflow.plans import catalog


def test_whole_texts_are_normalised(spark, sf):
    want = {r.doc_id: re.sub(r"\s+", " ", unicodedata.normalize("NFC", f"  \u00e9\t{r.text} ")).strip() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.keyword for r in catalog.QUERIES["key_normalize_whole"](spark, sf).collect()}
    assert got == want and max(map(len, got.values())) > 1000
