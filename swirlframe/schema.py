"""Fixed schemas of the library's tables."""

TABLE_SCHEMA_VERSION = "swirlframe-table-1"
RESULTS_FORMAT_VERSION = 1
#: Columns of an exported table, in order, with their types.
TABLE = (
    ("schema_version", "string"), ("result_type", "string"), ("frame_id", "string"), ("source_a", "string"), ("source_b", "string"), ("point_id", "int"),
    ("i", "int"), ("j", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("u", "double"), ("v", "double"), ("w", "double"),
    ("masked", "boolean"), ("outlier", "boolean"), ("peak_ratio", "double"), ("correlation_moment", "double"),
    ("uncertainty_u", "double"), ("uncertainty_v", "double"), ("uncertainty_w", "double"), ("match_residual", "double"),
    ("index_a", "int"), ("index_b", "int"), ("length_unit", "string"), ("time_unit", "string"), ("velocity_unit", "string"),
)
TABLE_COLUMNS = tuple(n for n, _ in TABLE)
FRAMES = "recording string, camera int, frame_idx int, ts double, label string, n_rows int, n_cols int, pixels array<double>"
VECTORS = "pair_id long, gi int, gj int, x double, y double, u double, v double, peak_ratio double, correlation_moment double, uncertainty_u double, uncertainty_v double, outlier boolean, masked boolean"
STEREO = "pair_id long, gi int, gj int, x double, y double, z double, u double, v double, w double, uncertainty_u double, uncertainty_v double, uncertainty_w double, outlier boolean, masked boolean"
PARTICLES = "frame_idx long, particle_id int, x double, y double, intensity double, diameter double"
MATCHES = "pair_id long, index_a int, index_b int, x double, y double, u double, v double, match_residual double, outlier boolean"
TRACKS = "recording string, track_id int, start_frame long, points array<struct<frame:long,x:double,y:double>>"
