"""Parsers, syntax trees and the step grid."""
