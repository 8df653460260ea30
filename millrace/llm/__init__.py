"""Training-data operators: text cleaning, de-duplication, tokenisation and scoring on Spark."""
