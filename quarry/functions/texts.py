"""Text formats that must equal the reference's output word for word.

Fixed values, in the order a question's context is assembled.  Placeholders
are Java format specifiers (``format_string``).
"""

# --- Fixed values: vector few-shot block (V6, K2) ---------------------------
FEW_SHOT_HEADER = "As a strict reference, here are some examples:\n"
FEW_SHOT_EXAMPLE = "- Example Question: '%s'\n  Expected SQL: %s\n\n"
VECTOR_TAIL = "Use the examples above to solve the following question:\nCurrent Question: "

# --- Fixed values: schema router (L2) ----------------------------------------
ROUTER_EXAMPLES = "Examples: [%s]"
NO_EXAMPLES = "No example values available"

# --- Fixed values: graph navigation text (N1, N12, N13, N14-N17) ------------
NO_VALID_TABLES = "No valid historical tables identified."
SINGLE_TABLE = "### SINGLE TABLE QUERY ###\nNo JOINs required.\n"
JOIN_HEADER = "### SUGGESTED JOIN CONDITIONS ###\n"
JOIN_RULE_ONE = "- For joining %s and %s use: %s"
JOIN_RULE_MANY = ("- For joining %s and %s, multiple valid conditions exist depending on context, "
                  "choose the correct one: %s")
NO_PATHS = "No historical JOIN paths found.\n"
METADATA_HEADER = "\n### HISTORICAL METADATA ###\n"
TABLE_LINE = "\nTable: [%s]\n"
V1_TOP_COLUMN = "%s (freq: %d)"
V1_TOP_COLUMNS = "  - Top Columns: %s\n"
V1_NO_COLUMNS = "  - Top Columns: None\n"
V1_NO_FILTERS = "  - Common Filters: None\n"
V2_TOP_COLUMNS = "  - Frequently referenced columns: %s\n"
V2_SAMPLES_HEADER = "  - Sample data formats:\n"
V2_SAMPLE_LINE = "    * %s: [%s]\n"
V2_PATTERNS_HEADER = "  - Historical SQL patterns:\n"
V2_PREDICATES = "    * WHERE clauses frequently use: %s\n"
V2_OPERATIONS = "    * Used operators: %s\n"
V2_AGGREGATIONS = "    * Aggregations: %s\n"
V2_NO_PATTERNS = "    * No structural patterns identified.\n"

# --- Fixed values: context strategies (K3-K5) --------------------------------
GRAPH_CTX_HEAD = "Historical Context from Graph RAG:\n"
QUESTION_TAIL = "\n\nUse this context to solve the following question:\nCurrent Question: "
HYBRID1_SEMANTIC = "\n        --- SEMANTIC CONTEXT (Examples) ---\n        "
HYBRID1_STRUCTURAL = "\n\n        --- STRUCTURAL CONTEXT (Graph Rules) ---\n        "
HYBRID1_END = "\n        "
HYBRID2_SEMANTIC = "\n\n--- SEMANTIC CONTEXT (Examples) ---\n"
HYBRID2_ENTITIES = "--- ENTITY RESOLUTION (Sample Values) ---\n"
HYBRID2_ENTITY_TABLE = "Table [%s]:\n"
HYBRID2_ENTITY_COLUMN = "  - Column '%s' matches categorical values: [%s]\n"
HYBRID2_STRUCTURAL = "--- STRUCTURAL CONTEXT (Graph Rules) ---\n"
HYBRID2_QUESTION = "--- USER QUESTION ---\nGenerate the SparkSQL query to answer the following question:\n"

# --- Fixed values: catalog (C5, C7) -------------------------------------------
SAMPLE_ROWS_HEADER = "%d rows from %s table:\n"
UNKNOWN_TABLES = "Error: table_names {%s} not found in database"

# --- Fixed values: telemetry and log summary (T2, R2) ------------------------
EARLY_EXIT_SCHEMA = "Early Exit because of call to SQL. Duration is spark_time."
EARLY_EXIT_OTHER = "EXCEPTION: Early Exit. Duration is off."
NOT_FOUND = "Not found"
NO_SQL = "No SQL generated"
NOT_AVAILABLE = "Not available"
