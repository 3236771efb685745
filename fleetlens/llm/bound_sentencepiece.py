"""op3: all documents encoded and decoded."""

import public_tokenizers

from fleetlens.llm.queries import query, table
from fleetlens.llm.sentencepiece_fst import encode_decode

MODEL = "piece_bpe_32k.model"


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL)).drop("text")
