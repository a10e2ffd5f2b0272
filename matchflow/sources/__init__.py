"""Reading and writing traces, postings, pages and reports."""
