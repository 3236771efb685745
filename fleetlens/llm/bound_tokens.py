"""op8: token counts of all documents."""

import public_tokenizers

from fleetlens.llm.queries import query, table
from fleetlens.llm.storage import new_folder
from fleetlens.llm.token_counts import token_counts

TOKENIZER = "byte_bpe_50k.json"


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(TOKENIZER), new_folder(spark, "token-counts")).drop("text")
