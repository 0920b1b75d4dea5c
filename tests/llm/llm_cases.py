"""What several tests of the training-data operators start from."""

SMALL = "/root/testdata/sf0.001"

ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, key string, label int"
