"""Training-data operators on Spark; nothing else in the library imports this
package (see ``queries`` for the registered queries)."""
