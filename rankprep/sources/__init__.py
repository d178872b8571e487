"""Readers and the writer."""

from .readers import check_agreement, check_header, field_schema, read_corpus, read_interactions, read_sparse_dataset, read_sparse_multilabel, read_triples, role_of, write_table

__all__ = [
    "check_agreement", "check_header", "field_schema", "read_corpus", "read_interactions", "read_sparse_dataset", "read_sparse_multilabel", "read_triples", "role_of", "write_table",
]
