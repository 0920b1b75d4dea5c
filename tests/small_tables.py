"""Where the smallest given tables lie."""

SMALL = "/root/testdata/sf0.001"
