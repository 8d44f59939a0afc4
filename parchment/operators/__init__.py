"""DataFrame operators. Blocks, pages, hierarchy, tables and fields are flat tables keyed by document_id."""
