"""Structural analytics over source trees and tables, built on Spark DataFrames."""
