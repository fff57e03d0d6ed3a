"""What the sample warehouse of ``lineage`` must give, as literal rows.

The rows were recorded from the engine and read through against the statements, so they guard against changes rather than
prove anything by themselves; walks over the edges are computed again by DuckDB, and tests/test_lineage.py has lineage
that was written down first.
"""

EDGES: list[tuple[str, str]] = [
    ("customer.c_acctbal", "staging.customer.balance"),
    ("customer.c_custkey", "staging.customer.customer_id"),
    ("customer.c_name", "staging.customer.name"),
    ("customer.c_nationkey", "staging.customer.nation_id"),
    ("lineitem.l_discount", "stg_orders:cte:lines.net"),
    ("lineitem.l_extendedprice", "stg_orders:cte:lines.net"),
    ("lineitem.l_orderkey", "stg_orders:cte:lines.l_orderkey"),
    ("lineitem.l_returnflag", "stg_orders:cte:lines.l_orderkey"),
    ("lineitem.l_returnflag", "stg_orders:cte:lines.net"),
    ("mart.revenue.nation", "mart.nation.nation"),
    ("mart.revenue.revenue", "mart.nation.place"),
    ("mart.revenue.revenue", "mart.nation.revenue"),
    ("nation.n_name", "mart.revenue.nation"),
    ("nation.n_nationkey", "mart.revenue.nation"),
    ("orders.o_custkey", "staging.orders.customer_id"),
    ("orders.o_orderkey", "staging.orders.order_id"),
    ("orders.o_orderkey", "staging.orders.revenue"),
    ("staging.customer.customer_id", "mart.revenue.customer_id"),
    ("staging.customer.customer_id", "mart.revenue.n_orders"),
    ("staging.customer.customer_id", "mart.revenue.revenue"),
    ("staging.customer.name", "mart.revenue.name"),
    ("staging.customer.nation_id", "mart.revenue.nation"),
    ("staging.orders.customer_id", "mart.revenue.n_orders"),
    ("staging.orders.customer_id", "mart.revenue.revenue"),
    ("staging.orders.order_id", "mart.revenue.n_orders"),
    ("staging.orders.revenue", "mart.revenue.revenue"),
    ("stg_orders:cte:lines.l_orderkey", "staging.orders.revenue"),
    ("stg_orders:cte:lines.net", "staging.orders.revenue"),
]

TABLE_EDGES: list[tuple[str, str]] = [
    ("customer", "staging.customer"),
    ("lineitem", "staging.orders"),
    ("mart.revenue", "mart.nation"),
    ("nation", "mart.revenue"),
    ("orders", "staging.orders"),
    ("staging.customer", "mart.revenue"),
    ("staging.orders", "mart.revenue"),
]

ROWS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "lineage_edges": (
        {"src": "VARCHAR", "dst": "VARCHAR", "edge_type": "VARCHAR"},
        [
            ('lineitem.l_discount', 'stg_orders:cte:lines.net', 'expression'),
            ('lineitem.l_extendedprice', 'stg_orders:cte:lines.net', 'expression'),
            ('lineitem.l_orderkey', 'stg_orders:cte:lines.l_orderkey', 'direct_column'),
            ('lineitem.l_returnflag', 'stg_orders:cte:lines.l_orderkey', 'where_filter'),
            ('lineitem.l_returnflag', 'stg_orders:cte:lines.net', 'where_filter'),
            ('orders.o_custkey', 'staging.orders.customer_id', 'expression'),
            ('orders.o_orderkey', 'staging.orders.order_id', 'expression'),
            ('orders.o_orderkey', 'staging.orders.revenue', 'join_predicate'),
            ('stg_orders:cte:lines.l_orderkey', 'staging.orders.revenue', 'join_predicate'),
            ('stg_orders:cte:lines.net', 'staging.orders.revenue', 'aggregate'),
        ],
    ),
    "metadata_comment_parse": (
        {"full_name": "VARCHAR", "description": "VARCHAR", "owner": "VARCHAR", "pii": "BOOLEAN", "tags": "VARCHAR"},
        [
            ('staging.customer.balance', 'Account balance', 'finance', False, ''),
            ('staging.customer.customer_id', 'Key of the customer', 'crm', False, 'key'),
            ('staging.customer.name', 'Full name', 'crm', True, 'contact'),
        ],
    ),
    "metadata_propagate": (
        {"node": "VARCHAR", "pii": "BOOLEAN", "owner": "VARCHAR", "tags": "VARCHAR"},
        [
            ('mart.nation.nation', False, None, ''),
            ('mart.nation.place', False, None, ''),
            ('mart.nation.revenue', False, None, ''),
            ('mart.revenue.customer_id', False, 'crm', 'key'),
            ('mart.revenue.n_orders', False, None, ''),
            ('mart.revenue.name', True, 'crm', 'contact'),
            ('mart.revenue.nation', False, None, ''),
            ('mart.revenue.revenue', False, None, ''),
        ],
    ),
    "pipeline_diff": (
        {"full_name": "VARCHAR", "change": "VARCHAR", "field": "VARCHAR"},
        [
            ('mart.revenue.last_order', 'added', None),
            ('mart.revenue.n_orders', 'removed', None),
            ('staging.customer.balance', 'modified', 'expression'),
        ],
    ),
    "observed_joins": (
        {"a": "VARCHAR", "b": "VARCHAR", "n_queries": "BIGINT"},
        [
            ('nation.n_nationkey', 'staging.customer.nation_id', 1),
            ('staging.customer.customer_id', 'staging.orders.customer_id', 1),
        ],
    ),
    "candidate_joins": (
        {"left_table": "VARCHAR", "right_table": "VARCHAR", "left_column": "VARCHAR", "right_column": "VARCHAR"},
        [
            ('mart.contact', 'mart.revenue', 'cid', 'customer_id'),
            ('mart.contact', 'mart.revenue', 'contact_name', 'name'),
        ],
    ),
    "keyword_rank": (
        {"table_name": "VARCHAR", "score": "DOUBLE"},
        [
            ('customer', 6.0),
            ('lineitem', 1.0),
            ('mart.nation', 7.0),
            ('mart.revenue', 9.0),
            ('nation', 6.0),
            ('orders', 1.0),
            ('staging.customer', 9.0),
            ('staging.orders', 5.0),
        ],
    ),
    "search_columns": (
        {"table_name": "VARCHAR", "column_name": "VARCHAR"},
        [
            ('mart.nation', 'revenue'),
            ('mart.revenue', 'revenue'),
            ('staging.orders', 'revenue'),
        ],
    ),
    "governance_quality": (
        {"table_name": "VARCHAR", "n_columns": "BIGINT", "described": "BIGINT", "owned": "BIGINT", "pii": "BIGINT"},
        [
            ('customer', 4, 0, 0, 0),
            ('lineitem', 4, 0, 0, 0),
            ('mart.nation', 3, 0, 0, 0),
            ('mart.revenue', 5, 0, 0, 0),
            ('nation', 2, 0, 0, 0),
            ('orders', 2, 0, 0, 0),
            ('staging.customer', 4, 3, 3, 1),
            ('staging.orders', 3, 0, 0, 0),
        ],
    ),
    "list_tags": (
        {"tag": "VARCHAR", "n": "BIGINT"},
        [
            ('contact', 1),
            ('key', 1),
        ],
    ),
    "export_columns_csv": (
        {"full_name": "VARCHAR", "table_name": "VARCHAR", "column_name": "VARCHAR", "layer": "VARCHAR", "node_type": "VARCHAR", "owner": "VARCHAR"},
        [
            ('mart.nation.nation', 'mart.nation', 'nation', 'output', 'direct_column', None),
            ('mart.nation.place', 'mart.nation', 'place', 'output', 'window', None),
            ('mart.nation.revenue', 'mart.nation', 'revenue', 'output', 'aggregate', None),
            ('mart.revenue.customer_id', 'mart.revenue', 'customer_id', 'output', 'direct_column', None),
            ('mart.revenue.n_orders', 'mart.revenue', 'n_orders', 'output', 'aggregate', None),
            ('mart.revenue.name', 'mart.revenue', 'name', 'output', 'direct_column', None),
            ('mart.revenue.nation', 'mart.revenue', 'nation', 'output', 'expression', None),
            ('mart.revenue.revenue', 'mart.revenue', 'revenue', 'output', 'aggregate', None),
            ('staging.customer.balance', 'staging.customer', 'balance', 'output', 'expression', 'finance'),
            ('staging.customer.customer_id', 'staging.customer', 'customer_id', 'output', 'expression', 'crm'),
            ('staging.customer.name', 'staging.customer', 'name', 'output', 'expression', 'crm'),
            ('staging.customer.nation_id', 'staging.customer', 'nation_id', 'output', 'expression', None),
            ('staging.orders.customer_id', 'staging.orders', 'customer_id', 'output', 'expression', None),
            ('staging.orders.order_id', 'staging.orders', 'order_id', 'output', 'expression', None),
            ('staging.orders.revenue', 'staging.orders', 'revenue', 'output', 'aggregate', None),
        ],
    ),
}
