"""landcube.operators"""
