"""Table builders and analytical queries, each a DataFrame in and a DataFrame out."""
