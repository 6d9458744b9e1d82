"""The registered queries stated a second time, in SQL for another engine.

The statements share only the derived-table SQL with the library.  Where the library uses running
windows they use joins, ranks or recursion-free level steps where that is possible.
"""

from oracle.statements import oracle_sql

__all__ = ["oracle_sql"]
