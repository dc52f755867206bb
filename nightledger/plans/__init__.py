"""The registered queries with their DuckDB SQL."""
