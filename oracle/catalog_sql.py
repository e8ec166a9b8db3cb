"""All oracle statements by query name."""

from oracle import evaluation_sql, table_sql

SQL = {**evaluation_sql.SQL, **table_sql.SQL}
