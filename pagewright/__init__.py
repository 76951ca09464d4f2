"""A DataFrame engine that audits how well web pages can be reached, read, identified, trusted and landed on."""
