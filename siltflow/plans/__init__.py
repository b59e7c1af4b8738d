"""Plans made of operators: configuration, formats, routes, publishing."""
