"""Column expressions: every function takes and returns Columns, none needs Python workers."""
