"""Where the tests' tables are."""

SF = "/root/testdata/sf0.001"
