"""Operators of a training-data pipeline: packing, deduplication, filters, language, token counts and mixing.

Nothing else in the library imports this subpackage. ``queries`` and ``oracle_sql`` give its operators over the supplied tables.
"""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with the job, so the workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries():
    from pubmeter.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from pubmeter.llm.registered import SQL

    return dict(SQL)
