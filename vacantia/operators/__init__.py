"""DataFrame operators: filters, features, scoring, merge, actions, serving."""
