"""The query on media columns: the embeddings drawn as pictures, cropped, halved, turned and darker copies of a twentieth searched in all."""

from passages.llm.images import copies, rendered
from passages.llm.registry import query, table


@query("op5_media_copies")
def op5_media_copies(spark, sf_dir):
    return copies(rendered(table(spark, sf_dir, "embeddings")))
