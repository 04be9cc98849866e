"""Reading published filings and writing the tables made from them."""
