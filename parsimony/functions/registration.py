"""SQL names for the scalar operators, all as Arrow functions of the kernel; in DataFrames ``scalars`` has native forms of most."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import ReduceConfig


def register(spark: SparkSession, config: ReduceConfig | None = None) -> list[str]:
    """Register the scalars for ``spark.sql``; returns their names."""
    from ..operators import kernel

    config = config or ReduceConfig()
    lexicon = kernel.Lexicon()

    def each(f, kind):
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else f(t))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)

    made = {
        "estimate_tokens": each(kernel.estimate_tokens, "bigint"),
        "reduce_text": each(lambda t: kernel.reduce_text(t, config, lexicon)[0], "string"),
        "shrink_prose": each(kernel.shrink_prose, "string"),
        "protected_literals": each(lambda t: kernel.protect(t)[1], "array<string>"),
        "term_graph": each(lambda t: kernel.term_graph(t, config.base_level, lexicon), "string"),
        "text_structure": each(lambda t: kernel.structure(t, config.base_level, lexicon), "string"),
        "word_class": each(lexicon.classify, "string"),
        "word_lemma": each(lexicon.lemma, "string"),
        "base_forms": each(kernel.base_forms, "array<string>"),
        "cleanup_arrows": each(kernel.cleanup_arrows, "string"),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
