"""Unicode forms and url resolution, which Spark has no expression for: vectorised, in Arrow batches."""

import unicodedata
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from recordloom.functions import text as tx


def _each(f: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return run


def _join(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:  # brackets without an address
        return None


@pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """`href` as seen from `base`; null if either is, or if it is no url."""
    return pd.Series([_join(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


#: Compatibility composition.
nfkc = pandas_udf(_each(lambda s: unicodedata.normalize("NFKC", s)), StringType())
#: Compatibility decomposition, what is beyond ASCII dropped.
nfkd_ascii = pandas_udf(_each(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()), StringType())
#: For comparison without case.
casefold = pandas_udf(_each(str.casefold), StringType())


def name_slug(c: Column | str, size: int = 70) -> Column:
    """The file slug of a title whose accents are dropped first."""
    return tx.file_slug(nfkd_ascii(c), size)


def heading_form(c: Column | str) -> Column:
    """The form in which headings are compared: composed, no zero-width spaces, plain apostrophes, collapsed, without case."""
    return casefold(tx.collapse(F.translate(nfkc(c), "\u2019\u2018\u200b", "''")))
