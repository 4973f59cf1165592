"""Training-data operators: ten dealt components, each a DataFrame in and a DataFrame out."""
