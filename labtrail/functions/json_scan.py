"""Brace matching over text columns (Arrow batches; brackets nest, so no
regular expression can do it)."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_balanced(texts: Column) -> Column:
    """The balanced object a text starts with, null when it never closes."""

    # defined here so that it travels to the executors by value
    def cut_all(column: pd.Series) -> pd.Series:
        import re

        # a string literal (closed or running to the end), or one brace
        lexeme = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', re.S)

        def cut(text):
            depth = 0
            for m in lexeme.finditer(text or ""):
                first = m.group()[0]
                depth += (first == "{") - (first == "}")
                if depth == 0 and first == "}":
                    return text[: m.end()]
            return None

        return column.map(cut)

    return F.pandas_udf(cut_all, T.StringType())(texts)
