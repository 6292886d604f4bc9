"""Pages to parsed documents: text, title, description, keywords, headers, JSON-LD and microdata in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    h = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.create_map(*[x for k in range(1, 7) for x in (F.lit(f"h{k}"), T.html_headers(h, k))])
    return pages.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.lit("html").alias("type"),
        T.clean_html(h).alias("content"),
        F.struct(
            F.lit("html").alias("source_type"), T.html_title(h).alias("title"), T.html_meta(h, "description").alias("description"),
            T.html_keywords(h).alias("keywords"), F.lit("en").alias("language"),
        ).alias("metadata"),
        F.struct(T.html_json_ld(h).alias("json_ld"), T.html_microdata(h).alias("microdata"), headers.alias("headers")).alias("structured_data"),
        F.col(url_col).alias("source_url"),
    )
