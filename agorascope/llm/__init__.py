"""Training-data operators: ten independent operators over a documents table and their queries."""
