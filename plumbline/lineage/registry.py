"""Closed lists of function names and what they mean for lineage."""

AGGREGATES = {
    "array": {"array_agg", "array_concat_agg", "collect_list", "collect_set", "arrayagg"},
    "string": {"string_agg", "listagg", "group_concat", "concat_ws"},
    "object": {"object_agg", "map_agg", "json_agg", "jsonb_agg", "json_object_agg", "jsonb_object_agg"},
    "statistical": {"percentile_cont", "percentile_disc", "approx_quantiles", "median", "mode", "corr", "covar_pop", "covar_samp", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "approx_percentile", "percentile"},
    "scalar": {"sum", "count", "avg", "min", "max", "any_value", "first_value", "last_value", "bit_and", "bit_or", "bit_xor", "bool_and", "bool_or", "max_by", "min_by", "count_if"},
}
AGGREGATE_TYPE = {f: kind for kind, names in AGGREGATES.items() for f in names}

RETURN_TYPES = {
    **{f: "array" for f in AGGREGATES["array"]}, **{f: "string" for f in AGGREGATES["string"]}, **{f: "object" for f in AGGREGATES["object"]},
    "count": "integer", "avg": "float", "sum": "numeric", **{f: "float" for f in ("stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr", "covar_pop", "covar_samp", "median", "percentile_cont", "percentile_disc")},
}

RANKING = {"row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist"}

JSON_FUNCTIONS = {
    "json_extract", "json_extract_scalar", "json_value", "json_query", "json_extract_string_array", "json_extract_array", "get_path", "get", "json_extract_path_text", "try_parse_json", "parse_json",
    "jsonb_extract_path", "jsonb_extract_path_text", "json_extract_path", "json_unquote", "get_json_object", "json_tuple", "json_extract_string", "from_json", "variant_get", "try_variant_get",
}

TVF_KINDS = {
    "generator": {"generate_series", "generate_date_array", "generate_timestamp_array", "sequence", "generator", "range"},
    "column_input": {"flatten", "explode", "posexplode", "explode_outer", "posexplode_outer", "inline", "stack"},
    "external": {"read_csv", "read_parquet", "read_json", "read_ndjson", "external_query", "read_files"},
    "system": {"table", "result_scan"},
}
TVF_KIND = {f: kind for kind, names in TVF_KINDS.items() for f in names}
TVF_COLUMNS = {
    "generate_series": ["generate_series"], "generate_date_array": ["date"], "generate_timestamp_array": ["timestamp"], "sequence": ["value"], "generator": ["seq4"], "range": ["range"],
    "flatten": ["value", "index", "key", "path", "this"], "explode": ["col"], "explode_outer": ["col"], "posexplode": ["pos", "col"], "posexplode_outer": ["pos", "col"],
}
