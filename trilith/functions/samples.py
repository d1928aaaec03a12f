"""A user's function, aggregate and table function, as the catalogue registers them.

No postponed annotations here: pandas UDFs read their types from these.
"""

import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf


@pandas_udf("double")
def shifted(x: pd.Series) -> pd.Series:
    return x + 1


@pandas_udf("double")
def spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


@udtf(returnType="d int")
class Digits:
    def eval(self, n: int):
        for ch in str(n):
            yield (int(ch),)
